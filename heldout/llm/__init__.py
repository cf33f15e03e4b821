"""Operators for preparing training data: mixing, encoding, quality, search, similarity, sharding, secrets."""
