"""textprov.plans."""
