"""Streaming of the signal-analytics library."""
