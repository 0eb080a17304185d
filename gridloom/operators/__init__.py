"""Operators on pixel tables, maps, matrices and metrics."""
