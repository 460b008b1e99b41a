"""Operators over vector tables, grids, daily series and habitat graphs."""
