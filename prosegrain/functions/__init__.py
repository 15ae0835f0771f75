"""Column functions: tokens, spans of matches, blocks of text."""
