"""Operators of a training-data pipeline; each module states its method and its behaviour on odd input."""
