"""Code-graph analytics on PySpark."""
