"""Operators over text for training data: look-alike forms, near duplicates, token ids, mixtures, harmful content."""
