"""Stain normalization and tissue analytics of slide images on Spark DataFrames."""
