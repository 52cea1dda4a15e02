"""Batch monitoring of scored data, expressed as Spark DataFrame plans."""
