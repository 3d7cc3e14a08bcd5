"""Readers, writers, the product registry and provenance rows."""
