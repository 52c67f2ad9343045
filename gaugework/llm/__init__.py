"""Operators for preparing training text: scoring, cleaning, tokens, fingerprints, packing."""
