"""Operators of a training-data pipeline: duplicates, tokens, shards, packing, filters, extraction."""
