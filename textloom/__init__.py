"""textloom: text retrieval and corpus analytics on Spark DataFrames."""
