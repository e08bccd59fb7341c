"""cohortlens: data-quality, master-data and study-table analytics on Spark DataFrames."""
