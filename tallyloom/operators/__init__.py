"""Operators of the activity-analytics engine."""
