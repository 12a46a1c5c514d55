"""Whole workflows, from cubes to skill maps."""
