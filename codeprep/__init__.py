"""Clinical notes to model-ready datasets, and bulk scoring, on Spark DataFrames."""
