"""Operators of a training-data pipeline: quality, language models, tokens,
mixing, secrets, web archives, near-duplicates and URL filters."""
