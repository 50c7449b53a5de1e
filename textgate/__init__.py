"""textgate: corpus curation and verdict evaluation on Spark DataFrames."""
