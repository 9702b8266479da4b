"""Operators of the signal-analytics library."""
