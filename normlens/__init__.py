"""normlens: normal-only anomaly analytics over feature vectors, expressed as Spark DataFrames."""
