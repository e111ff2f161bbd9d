"""Bars from tables, files and caches."""
