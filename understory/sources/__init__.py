"""Readers, writers and the table schemas."""
