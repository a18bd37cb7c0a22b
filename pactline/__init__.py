"""Contract and drift analytics over event tables and streams, on Spark."""
