"""Functions on columns and plain values."""
