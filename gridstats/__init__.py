"""Race-results analytics as lazy Spark DataFrame operators."""
