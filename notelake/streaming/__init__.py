"""Streaming forms of the note operators."""
