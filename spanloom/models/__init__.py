"""spanloom models."""
