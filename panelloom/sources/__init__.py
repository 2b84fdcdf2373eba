"""Readers, writers and schema checks."""
