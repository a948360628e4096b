"""Operators for preparing note collections as training text."""
