"""textprov.functions."""
