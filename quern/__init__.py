"""A relational query engine on PySpark."""
