"""Scans: parquet tables, JSON lines, CSV, id logs and XML catalogs."""
