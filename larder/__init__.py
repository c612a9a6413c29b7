"""Place catalog, enrichment and recommendation jobs on Spark DataFrames."""
