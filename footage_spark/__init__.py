"""High-speed-camera recordings as Spark DataFrames."""
