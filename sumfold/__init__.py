"""Local-computation analytics over factors, expressed as PySpark DataFrames."""
