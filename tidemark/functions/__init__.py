"""Subpackage of the signal analytics engine."""
