"""Spatial, similarity, sequence, graph, time-series and statistical queries over Spark DataFrames."""
