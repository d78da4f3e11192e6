"""Sources of the activity-analytics engine."""
