"""matchloom: entity resolution on Spark DataFrames."""
