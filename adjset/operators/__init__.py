"""adjset operators."""
