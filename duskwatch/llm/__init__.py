"""Operators for training-data pipelines over a table of documents; nothing else in the library imports them."""
