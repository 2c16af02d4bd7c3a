"""Column functions: geometry, units and text, catalogue lookups."""
