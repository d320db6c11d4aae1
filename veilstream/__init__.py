"""Privacy-first activity analytics on PySpark."""
