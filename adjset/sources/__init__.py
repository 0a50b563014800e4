"""adjset sources."""
