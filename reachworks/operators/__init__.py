"""Operators: columns, joins, aggregates, windows, reshaping, estimators, forests, survey models, space."""
