"""Point lookups, fan-out and rasters over gridded fields."""
