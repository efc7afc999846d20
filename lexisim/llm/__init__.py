"""Operators of a training-data pipeline: mixing, similarity joins, classifiers, tokenisers, scans and filters."""
