"""Codecs for keys and documents, on the driver and as Spark columns."""
