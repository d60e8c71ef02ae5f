"""Column expressions: hashing, text, vectors and intervals."""
