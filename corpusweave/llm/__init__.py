"""Operators of a training-data pipeline: extraction, quality, copies, secrets, archives, mixing, shards."""
