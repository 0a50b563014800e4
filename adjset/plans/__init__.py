"""adjset plans."""
