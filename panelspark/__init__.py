"""panelspark: a Spark-first analytics engine for date x entity panels."""
