"""Readers of rasters, annotation files and driver tables."""
