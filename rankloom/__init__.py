"""Page-audit and ranking analytics as Spark DataFrame operators."""
