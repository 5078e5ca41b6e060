"""Operators of a training-data pipeline. Nothing else in grainfield imports this subpackage."""
