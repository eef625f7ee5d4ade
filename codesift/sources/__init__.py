"""Readers and the two Python batch jobs (syntax facts, caller's scorer)."""
