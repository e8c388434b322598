"""Specs, models, compiled SQL, metrics, lineage and the overlap graph."""
