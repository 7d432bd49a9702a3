"""Readers, writers and the retail view over the test tables."""
