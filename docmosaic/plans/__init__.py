"""Batch products composed from the operators."""
