"""Structured Streaming over audit events and arriving files."""
