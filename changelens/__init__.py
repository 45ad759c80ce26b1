"""PySpark-native analytics for multi-temporal rasters held as tables of cells."""
