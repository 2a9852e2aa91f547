"""Corpus analytics and training-data preparation as Spark jobs: DataFrames in, DataFrames out."""
