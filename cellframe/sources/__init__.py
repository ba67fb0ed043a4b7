"""Stores, table handles, partitioned Parquet, fragments and conversion."""
