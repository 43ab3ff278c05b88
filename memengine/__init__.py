"""Personal-activity analytics as Spark DataFrame operators."""
