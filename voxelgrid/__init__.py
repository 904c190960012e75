"""Tiled 2D and 3D rasters as Spark DataFrames: windows with halos, resampling, placement and audit."""
