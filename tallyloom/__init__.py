"""Activity-log analytics expressed as Spark DataFrame operators."""
