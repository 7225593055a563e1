"""Landed-file scans, typed loaders and sinks."""
