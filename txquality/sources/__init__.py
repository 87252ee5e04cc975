"""Readers, writers and the mapping of the given tables to transactions."""
