"""Whole plans: sweeps, walk-forward, analytics."""
