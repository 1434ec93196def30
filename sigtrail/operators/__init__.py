"""Detectors, gates, joins and clustering as DataFrame operators."""
