"""Column functions: text, vectors, language profiles."""
