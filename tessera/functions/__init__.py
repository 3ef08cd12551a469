"""Column expressions: hashes, buckets, paths, formats."""
