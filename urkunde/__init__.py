"""Metadata analytics over collections of scanned German documents, on Spark."""
