"""Scans: parquet splits, CSV, text lines, whole files, legacy windows."""
