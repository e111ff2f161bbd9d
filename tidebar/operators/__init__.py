"""Ordered per-symbol operators: indicators, signals, simulation, joins."""
