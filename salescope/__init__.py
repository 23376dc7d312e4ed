"""Sales decision analytics as Spark DataFrame operators."""
