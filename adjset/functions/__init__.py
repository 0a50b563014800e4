"""Column functions: the state lattice, positions, ids packed as bytes."""
