"""Operators for training text: encoding, mixing, quality statistics, hand-written source."""
