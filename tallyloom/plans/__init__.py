"""Plans of the activity-analytics engine."""
