"""Plans: workflows, policies, and the registered query catalog (Spark + DuckDB oracle SQL)."""
