"""Plans of the signal-analytics library."""
