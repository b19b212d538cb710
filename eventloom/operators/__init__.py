"""Relational operators over the event log."""
