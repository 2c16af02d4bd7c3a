"""Rate limits and debounced saves over streams."""
