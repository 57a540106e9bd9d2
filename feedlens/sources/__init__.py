"""Schemas, readers, sinks and fixture views."""
