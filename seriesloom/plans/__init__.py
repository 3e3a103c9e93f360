"""Whole jobs: the model competition, and the queries answered from its results."""
