"""Operators for preparing training text: quality, mixing, deduplication, encoding, language, toxicity, secrets."""
