"""The registered queries: inputs derived from the given tables, queries, and their SQL oracles."""
