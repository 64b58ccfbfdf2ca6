"""Column functions over words, spans and vectors."""
