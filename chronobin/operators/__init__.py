"""Relational operators of the event store."""
