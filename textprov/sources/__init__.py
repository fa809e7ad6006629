"""textprov.sources."""
