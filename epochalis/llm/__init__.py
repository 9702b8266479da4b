"""Training-data operators: packing, deduplication, scans, formatting, scoring."""
