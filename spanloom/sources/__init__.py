"""spanloom sources."""
