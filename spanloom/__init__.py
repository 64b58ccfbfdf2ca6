"""Entity-linking jobs and corpus preparation on Spark."""
