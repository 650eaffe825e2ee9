"""Reading inputs into panels and writing results as run-partitioned tables."""
