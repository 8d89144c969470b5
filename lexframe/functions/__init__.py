"""Column functions: text, numerals, identifiers."""
