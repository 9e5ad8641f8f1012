"""Clinical-series, text and training-data operators for PySpark."""
