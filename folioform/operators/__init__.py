"""folioform.operators."""
