"""Forest normalisation on Spark: nested link collections as DataFrames."""
