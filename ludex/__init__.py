"""Game-market analytics as PySpark DataFrame operators.

Modules:
  sources    -- test tables, landed feed files, warehouse derivation
  functions  -- Column-level helpers (predicates, labels, parsers)
  operators  -- DataFrame -> DataFrame operators (latest row, SCD2, series, tags, ...)
  plans      -- the named analytical queries and their SQL oracles
  streaming  -- Structured Streaming forms of the ingest feeds
"""

__all__ = ["session"]
