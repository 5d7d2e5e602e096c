"""Operators for training-data pipelines: counts of frequent items, percentiles, tokens, mixes, spam pages."""
