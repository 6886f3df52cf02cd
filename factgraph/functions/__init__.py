"""Column builders: text, names and vectors."""
