"""Operators of a training-data pipeline; the rest of the package never imports this."""
