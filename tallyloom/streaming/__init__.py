"""Streaming of the activity-analytics engine."""
