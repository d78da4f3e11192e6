"""Functions of the activity-analytics engine."""
