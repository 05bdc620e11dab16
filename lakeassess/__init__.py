"""Lake water-quality assessment as Spark DataFrame operators."""
