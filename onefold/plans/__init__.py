"""Whole plans: a folder of sources to canonical records, and the queries."""
