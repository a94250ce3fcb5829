"""Survey statistics and land-cover analytics as Spark DataFrame jobs."""
