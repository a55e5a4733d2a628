"""Operators on DataFrames of pixels, masks, scenes and grids."""
