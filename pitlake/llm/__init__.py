"""Operators for preparing a training corpus; nothing else in the library imports this package."""
