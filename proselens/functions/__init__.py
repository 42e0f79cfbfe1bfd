"""Column functions over text, spans and tokens."""
