"""Readers that turn bytes, pages and exports into rows."""
