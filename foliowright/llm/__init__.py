"""Operators for training-text preparation; nothing outside this package imports it."""
