"""strata: layered lakehouse operators written as plain PySpark DataFrame code."""
