"""Training-data operators on Spark DataFrames: deduplication, search, tokenising, labelling, mixing."""
