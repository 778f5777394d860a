"""Readers, the collection catalog and writers."""
