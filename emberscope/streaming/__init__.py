"""Profiles that keep arriving."""
