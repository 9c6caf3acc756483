"""From source text to facts: symbols, calls, imports, control flow and value flow of one file."""
