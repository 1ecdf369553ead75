"""docgrain: document retrieval analytics and corpus processing on Spark DataFrames."""
