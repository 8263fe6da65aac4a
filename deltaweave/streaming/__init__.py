"""Replication, events and letters on Structured Streaming."""
