"""Column-expression building blocks (built-in Spark functions only)."""
