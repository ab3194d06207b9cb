"""Document analytics on PySpark: text, relational, retrieval and evaluation operators."""
