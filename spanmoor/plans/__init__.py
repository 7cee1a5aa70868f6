"""Whole dataflows: extraction from given output, and runs with a provider."""

from .run import align, extract, run

__all__ = ["align", "extract", "run"]
