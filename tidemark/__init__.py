"""Session-memory analytics and retrieval on Spark DataFrames."""
