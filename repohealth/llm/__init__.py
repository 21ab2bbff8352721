"""Operators for large text collections; nothing else in the library imports this package."""
