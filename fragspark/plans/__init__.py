"""Whole commands: chains of operators with their options."""
