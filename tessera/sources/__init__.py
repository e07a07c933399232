"""Sources and sinks: fixture views, files, the live store."""
