"""Dataflow operators: DataFrames in, DataFrames out."""
