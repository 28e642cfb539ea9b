"""Radar raster, time-series and survey-table analytics on Spark DataFrames."""
