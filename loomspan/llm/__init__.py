"""Operators for text of language-model training data; nothing else in the library imports this package."""
