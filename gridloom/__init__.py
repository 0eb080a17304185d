"""Grids, images and elastic registration as DataFrames."""
