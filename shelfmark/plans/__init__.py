"""Whole queries: operators bound to concrete tables."""
