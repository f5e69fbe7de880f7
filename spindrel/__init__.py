"""spindrel: structure discovery in numeric, spectral and text data on Spark."""
