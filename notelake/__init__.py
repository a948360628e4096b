"""Spark operators over large collections of Markdown notes."""
