"""Text retrieval and index analytics as Spark DataFrames."""
