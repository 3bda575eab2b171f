"""Subpackage of the record-reconciliation engine."""
