"""Column-level building blocks: text, vectors and fixed values."""
