"""Column builders: every value rule as a Spark expression, no Python UDF."""
