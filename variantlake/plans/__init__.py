"""Registered queries: each derives its input from the driver tables with Spark,
runs library operators on it, and has (when SQL can express it) an oracle query
that DuckDB runs on the same parquet files."""
