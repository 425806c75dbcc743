"""folioform.functions."""
