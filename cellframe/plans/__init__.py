"""Schemas, templates and registered query plans."""
