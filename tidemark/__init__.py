"""Study analytics on Spark."""
