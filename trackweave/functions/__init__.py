"""Column functions: geometry, orbits, coercion and decoding."""
