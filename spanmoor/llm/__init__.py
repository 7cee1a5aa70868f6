"""Operators for building training corpora: mixing, deduplication, filtering,
decontamination, search, sharding and extraction.

Nothing else in the library imports this subpackage."""
