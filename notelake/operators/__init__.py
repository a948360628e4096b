"""Set-based operators over note tables."""
