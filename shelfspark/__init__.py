"""Product-catalog analytics on Spark: column functions, relational operators, sources, plans and streams."""
