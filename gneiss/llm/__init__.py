"""Operators for training-data corpora: filtering, de-duplication, archives, tokens, sharding."""
