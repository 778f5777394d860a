"""Structured Streaming: incremental ingestion and bounded conversation memory."""
