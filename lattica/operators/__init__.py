"""Grouped, joined and aggregated steps of an estimation."""
