"""Operators for training-data pipelines. Nothing else in emberflow imports this subpackage."""
