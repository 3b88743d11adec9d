"""Streams over the event log."""
