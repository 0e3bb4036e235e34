"""Page-geometry analytics on PySpark."""
