"""Operators on cubes: long tables of lat, lon, sample, feature, value."""
