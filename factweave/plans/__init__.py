"""What to compute: metric registries, report calendars, whole runs."""
