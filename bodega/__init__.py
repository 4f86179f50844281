"""Sales and stock analytics for a wholesale distributor, on Spark DataFrames.

Sub-packages:
  sources    typed scans, fixture adapters, JSON in/out
  functions  column expressions and distributed sequence helpers
  operators  reports, listings, order posting, table maintenance, migration
  plans      the registered queries and their DuckDB oracle text
  streaming  order intake as a Structured Streaming job
"""
