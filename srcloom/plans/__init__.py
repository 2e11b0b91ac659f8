"""Whole runs, the query catalog and its SQL counterparts."""
