"""fellway: terrain routing and geospatial batch analytics on PySpark."""
