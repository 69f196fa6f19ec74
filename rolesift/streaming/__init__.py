"""Structured Streaming forms of the recurring run and of suppression."""
