"""Table operators for league analytics on PySpark."""
