"""Operators of a training-data pipeline (mixing, tokens, quality, dedup, language)."""
