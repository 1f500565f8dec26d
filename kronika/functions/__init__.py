"""Column functions: kinds, coordinates, hashes, logical clocks, payload versions."""
