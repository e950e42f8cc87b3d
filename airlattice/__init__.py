"""Spatio-temporal raster analytics as Spark DataFrame operations."""
