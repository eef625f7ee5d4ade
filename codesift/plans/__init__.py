"""Whole audits, composed from the operators."""
