"""Readers of people records: every source becomes rows of `model.RECORD`, without ord."""
