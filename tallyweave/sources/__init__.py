"""Feeds as DataFrames: files are read with declared schemas, raw rows parsed by Column expressions."""
