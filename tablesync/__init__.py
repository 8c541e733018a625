"""Table replication and verification on Spark DataFrames."""
