"""Operators on DataFrames: filters, groups, order, look-ups, updates, overlays, cubes."""
