"""Scans, file routing and sinks."""
