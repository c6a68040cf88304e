"""Checks, matching, review and reporting steps over the typed tables."""
