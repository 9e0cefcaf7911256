"""Layout reconciliation, union, aggregation and ordering over DataFrames."""
