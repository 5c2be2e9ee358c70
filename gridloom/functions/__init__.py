"""Column functions: the cell grid, projections, geometry and scalar rules."""
