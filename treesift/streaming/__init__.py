"""Keeping a snapshot current from change events."""
