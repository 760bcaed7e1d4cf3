"""Multi-site cohort analytics as Spark DataFrame operators."""
