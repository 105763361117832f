"""Design-system adoption analytics on PySpark."""
