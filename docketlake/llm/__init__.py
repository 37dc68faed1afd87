"""Operators for training-data preparation; nothing else in the package imports them."""
