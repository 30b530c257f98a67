"""vitals — repository-health analytics on Spark DataFrames.

Sub-packages:
  sources    readers for event files, Parquet tables and the test-data bindings
  functions  column-expression helpers (JSON paths, text, formatting, audits)
  operators  DataFrame -> DataFrame jobs (metrics, detection, retrieval, reports ...)
  plans      the registered queries and their DuckDB oracle SQL
  streaming  Structured Streaming versions of ingest and the daily roll-up
"""

__all__ = ["session"]
