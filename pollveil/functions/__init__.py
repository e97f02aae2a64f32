"""Scalar column functions on vote cells, signatures and patterns."""
