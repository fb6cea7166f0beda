"""Readers, writers, the daily tables and the checks on them."""
