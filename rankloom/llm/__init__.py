"""Operators for training text: kept apart, imported by nothing else in the library."""
