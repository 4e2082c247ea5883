"""matchloom: entity resolution on Spark DataFrames, from raw records to validated match lists."""
