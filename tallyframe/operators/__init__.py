"""Checks and transforms over DataFrames."""
