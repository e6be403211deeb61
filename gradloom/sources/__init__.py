"""Readers, writers, table builders and generators."""
