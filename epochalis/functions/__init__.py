"""Functions of the signal-analytics library."""
