"""Readers, sinks and declared schemas."""
