"""A document-pipeline analytics engine on PySpark."""
