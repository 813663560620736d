"""Operators on DataFrames: hierarchy, metrics, decisions, statistics, joins, audits, splits, variants, models."""
