"""Readers, table adapters and published-run storage."""
