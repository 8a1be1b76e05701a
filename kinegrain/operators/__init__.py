"""Operators over relations: motion tracks, rasters, matching and lookup."""
