"""Analytics for two-sided contests grouped in seasons, written as Spark jobs."""
