"""Operators for training text: canonical form, near copies, splitting, encoding, leaks, quality, scan repair."""
