"""Normalizers as Spark expressions: pure, and null for what they can't read."""
