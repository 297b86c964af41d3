"""Readers and writers: text archives, zipped archives, the Parquet lake, JSON payloads, cost tables."""
