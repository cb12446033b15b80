"""Streams over scoreboard files as they arrive."""
