"""folioform.sources."""
