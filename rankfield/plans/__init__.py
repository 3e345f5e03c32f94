"""Registered queries over ranked pages."""
