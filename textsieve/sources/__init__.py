"""Readers, sinks and the required-column gate."""
