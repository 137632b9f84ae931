"""Operators for preparing training data; optional, imported by nothing else in the library."""
