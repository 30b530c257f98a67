"""Readers: provided Parquet tables, fixture bindings, raw event files."""
