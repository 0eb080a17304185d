"""Column expressions on coordinates, and scalars of grids."""
