"""Adapters from stored tables to point tables and matrix tables."""
