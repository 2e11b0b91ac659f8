"""Scans of source files and sinks for results."""
