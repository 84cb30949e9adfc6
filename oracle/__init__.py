"""DuckDB statements of the registered queries, written from the definitions."""
