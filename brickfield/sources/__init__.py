"""Readers of volumes, points and graphs."""
