"""Readers and writers: JSON Lines of spans, text folders, task files, results."""
