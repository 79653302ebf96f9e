"""Relational and tree operators: DataFrames in, DataFrames out."""
