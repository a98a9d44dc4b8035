"""Column expressions, all of built-in Spark functions: no Python worker is needed for them."""
