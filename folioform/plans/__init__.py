"""folioform.plans."""
