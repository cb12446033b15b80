"""gradeline: a Spark-first engine for checking and costing infrastructure estimates."""
