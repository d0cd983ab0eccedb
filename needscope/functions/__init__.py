"""Column builders: no jobs, no joins, only Spark expressions."""
