"""Graph-evidence analytics as Spark DataFrame operators."""
