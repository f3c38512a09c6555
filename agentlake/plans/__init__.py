"""Query plans: registry of named Spark queries and their DuckDB oracles."""
