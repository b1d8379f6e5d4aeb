"""Operators for training-data pipelines: scoring, formatting, scans, joins and packing of text corpora."""
