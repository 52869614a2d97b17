"""Column functions, all of them built from Spark's own."""
