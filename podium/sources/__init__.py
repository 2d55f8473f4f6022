"""Readers and writers for pages, documents, CSV and parquet."""
