"""Operators for training-data pipelines: safety, contamination, duplicates, tokens, language, licences, pages."""
