"""Set-at-a-time operators over nuclear-data tables."""
