"""Named analytical queries (Spark) with their DuckDB oracle SQL."""
