"""Data-processing operators expressed as Spark plans."""
