"""adjset streaming."""
