"""Relational, graph, vector and matching operators: DataFrames in, DataFrames out."""
