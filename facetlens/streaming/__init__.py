"""Incremental ingestion built on Structured Streaming."""
