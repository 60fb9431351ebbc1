"""Case reasoning, document structuring and training-data operators on PySpark."""
