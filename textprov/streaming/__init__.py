"""textprov.streaming."""
