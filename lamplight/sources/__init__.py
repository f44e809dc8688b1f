"""Readers, writers and the mapping of the given tables onto the document model."""
