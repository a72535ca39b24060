"""Grouped commits and streaming sinks."""
