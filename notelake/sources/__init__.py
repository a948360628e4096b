"""File source, registry file and note tables."""
