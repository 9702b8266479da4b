"""Sources of the signal-analytics library."""
