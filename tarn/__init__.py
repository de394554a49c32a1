"""tarn: a document-pipeline analytics engine that plans entirely on Spark."""

__version__ = "0.1.0"
