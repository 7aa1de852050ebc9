"""foliant: a Spark-first engine for document quality analytics."""
