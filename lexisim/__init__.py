"""Pairwise string and sound similarity on Spark: scorers, ensembles, learning, and data preparation around them."""
