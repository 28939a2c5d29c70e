"""Column functions: digests, coordinates, names and times."""
