"""Readers, writers, schemas and external effects."""
