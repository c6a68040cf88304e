"""Whole jobs: the audit over all checks, the test-data views, and the registered queries."""
