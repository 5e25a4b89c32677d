"""Speech-timeline analytics as Spark DataFrame operators."""
