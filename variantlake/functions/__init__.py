"""Column-level functions: native Spark expressions first, Arrow helpers where needed."""
