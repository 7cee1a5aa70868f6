"""DataFrame-in, DataFrame-out operators over the column functions."""
