"""Citegrove: evidence retrieval, curation and evaluation as PySpark DataFrame operators."""
