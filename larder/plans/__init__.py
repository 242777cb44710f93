"""Registered queries over the sample warehouse and their SQL comparisons."""
