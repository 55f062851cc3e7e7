"""millrace: corpus preparation and batch-inference analytics on PySpark."""
