"""Business operators: DataFrames in, a DataFrame out."""
