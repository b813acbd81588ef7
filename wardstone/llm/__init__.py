"""Operators of a training-data pipeline over ``documents`` and ``embeddings``; nothing else in the library imports it."""
