"""Operators: filters, pipeline stages and updates."""
