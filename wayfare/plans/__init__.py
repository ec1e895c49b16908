"""Named query registry (Spark) and their DuckDB oracle twins."""
