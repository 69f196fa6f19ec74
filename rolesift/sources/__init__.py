"""Inputs and state: source configs, page frontier, landed pages, run tables."""
