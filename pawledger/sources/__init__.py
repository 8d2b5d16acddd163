"""Readers, scans, views and sinks."""
