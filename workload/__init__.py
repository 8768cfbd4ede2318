"""Driver-facing workload: fixtures over the given tables, registered queries and their oracles."""
