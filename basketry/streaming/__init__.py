"""Structured Streaming twins of the event-history operators."""
