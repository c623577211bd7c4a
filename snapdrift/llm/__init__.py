"""Operators over training text: duplicates, leaks, secrets, licences, scores and tokens."""
