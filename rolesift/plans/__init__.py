"""Whole jobs: one run, backfill, config check; and the query catalogue."""
