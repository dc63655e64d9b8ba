"""Spatial partition analytics on Spark: rasters, Voronoi cells, boundaries, components."""
