"""Readers and writers of rasters, orbits, surveys and electron-content files."""
