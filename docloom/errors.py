"""Errors of the compiler."""


class UnsupportedOperator(ValueError):
    """An operator the engine does not have."""


class BadSpec(ValueError):
    """A malformed filter, stage, expression or update."""
