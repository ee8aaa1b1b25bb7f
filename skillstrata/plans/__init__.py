"""Whole runs: building the lake and refreshing it."""
