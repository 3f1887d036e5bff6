"""Column functions: tolerant parsing, folding, identifiers."""
