"""Readers and writers: station text, raster text, lookups, tile tables."""
