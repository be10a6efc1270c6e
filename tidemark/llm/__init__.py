"""Operators for preparing training data: filtering, deduplication, mixing, sharding and encoding of documents."""
