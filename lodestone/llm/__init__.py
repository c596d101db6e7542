"""Operators for preparing training text: dedup, language, quality, privacy, sharding, mixing, tokens."""
