"""A pipe-query engine on PySpark."""
