"""Record analytics on Spark DataFrames: catalog, filters, search, history, quality, matching, merging and feeds."""
