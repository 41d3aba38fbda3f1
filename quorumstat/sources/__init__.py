"""Scans, sinks, caches and run records."""
