"""Operators on records: keys, linkage, resolution, trust, projection and the store."""
