"""coterie: association-pattern analytics on transactions, written as Spark DataFrame jobs."""
