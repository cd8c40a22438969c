"""Column functions: strict casts, number rendering and fingerprints."""
