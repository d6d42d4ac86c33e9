"""Operators for large-scale text and training data; nothing outside this subpackage imports it."""
