"""Additive aggregates over streams."""
