"""Bars and causal indicators on streams."""
