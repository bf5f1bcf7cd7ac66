"""Operators for building training data: cleaning, near duplicates, archives, scoring, mixing, tokens."""
