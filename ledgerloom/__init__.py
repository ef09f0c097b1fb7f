"""Bank-statement analytics as Spark DataFrame operators."""
