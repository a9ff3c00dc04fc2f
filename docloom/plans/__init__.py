"""Logical plans: the pipeline compiler and the catalogue of registered queries."""
