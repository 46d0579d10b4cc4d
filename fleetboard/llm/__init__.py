"""Operators for training data: fingerprints, joins of near texts, sharding,
tokens, contamination, toxicity, quality and language."""
