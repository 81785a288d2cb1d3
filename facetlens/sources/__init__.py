"""Readers, writers and table conformance."""
