"""Column functions: text rules, Japanese units, URLs."""
