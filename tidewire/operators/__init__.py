"""DataFrame operators: filters, keyed writes, deduplication, ranking, admission."""
