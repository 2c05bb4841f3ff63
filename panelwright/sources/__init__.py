"""Scans, sinks and the tables derived directly from raw records."""
