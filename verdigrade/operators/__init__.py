"""Relational operators: scoring roll-ups, joins, comparison, calibration, references."""
