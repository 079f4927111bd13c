"""Multi-version keyed tables, scans, indexes, statistics and change feeds as Spark DataFrame plans."""
