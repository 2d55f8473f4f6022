"""Competition-results analytics as composable Spark DataFrame transformations."""
