"""Column-level functions: text, arrays, code tokens, signals."""
