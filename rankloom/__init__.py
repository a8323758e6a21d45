"""Hierarchically labelled sequences and embeddings as Spark DataFrames."""
