"""Operators of a training-data pipeline: filters, joins, packing, encoding."""
