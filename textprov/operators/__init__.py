"""textprov.operators."""
