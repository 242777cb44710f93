"""Reading, validating and writing tables."""
