"""Trustlake: data-trust operators over Spark DataFrames and streams."""
