"""Column builders: everything here stays inside Spark's own expressions."""
