"""Readers of sensor logs and feeds, and sinks for findings."""
