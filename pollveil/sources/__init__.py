"""Readers and writers of vote records."""
