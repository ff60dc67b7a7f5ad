"""rillflow: Spark-first analytics over ordered signals."""
