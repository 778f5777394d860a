"""Distributed operators: retrieval, ranking, chunking, matching, spatial joins, graphs."""
