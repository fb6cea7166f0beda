"""Chains of operators bound to tables, and the registry of named queries."""
