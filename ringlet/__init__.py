"""ringlet: graph-string analytics as PySpark DataFrame operations."""
