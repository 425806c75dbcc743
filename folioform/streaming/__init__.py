"""folioform.streaming."""
