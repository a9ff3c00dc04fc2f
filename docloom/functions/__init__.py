"""Expressions: typed columns and the compiler from expression documents."""
