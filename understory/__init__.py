"""Plot-survey analytics as Spark DataFrame operators."""
