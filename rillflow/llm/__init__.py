"""Operators for training-data pipelines; nothing else in rillflow imports this subpackage."""
