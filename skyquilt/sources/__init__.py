"""Where cubes come from and results go."""
