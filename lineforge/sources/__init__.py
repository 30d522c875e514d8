"""Readers and writers: parquet, delimited text, tables, zones, JSON pages, seeds."""
