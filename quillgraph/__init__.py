"""Notes, search and knowledge-graph analytics on PySpark."""
