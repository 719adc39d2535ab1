"""Software-supply analytics as Spark DataFrame operators."""
