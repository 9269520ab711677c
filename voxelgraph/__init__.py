"""Finite-volume construction on voxel domains, expressed as Spark DataFrames."""
