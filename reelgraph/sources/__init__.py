"""Readers, writers and the mapping of the benchmark tables onto the data model."""
