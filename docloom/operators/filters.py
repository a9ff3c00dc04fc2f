"""Filter documents to boolean columns; null stands for false, so that comparisons reach the scan as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import BadSpec, UnsupportedOperator
from docloom.functions import arrays, dates  # noqa: F401  they register their operators
from docloom.functions import values as V
from docloom.functions.expressions import compile_expr
from docloom.functions.values import Scope, Value


def equals(v: Value, operand) -> Column:
    """A null field or operand never equals; numbers compare as numbers, else by value or by text. Arrays only as a whole."""
    x = V.constant(operand)
    if v.is_null or x.is_null:
        return F.lit(False)
    if v.is_number and x.is_number:
        same_kind = isinstance(v.dtype, T.IntegralType) and isinstance(x.dtype, T.IntegralType)
        return (v.col == (x.col if same_kind else x.col.cast("double")))
    if v.is_text and x.is_text or (isinstance(v.dtype, T.BooleanType) and isinstance(x.dtype, T.BooleanType)):
        return (v.col == x.col)
    if v.is_time and x.is_time:
        return V.instant(v) == V.instant(x)
    return (V.text(v) == V.text(x))


def ordered(v: Value, operand, test) -> Column:
    """Numbers only; anything else on either side is false."""
    if not v.is_number or isinstance(operand, bool) or not isinstance(operand, int | float):
        return F.lit(False)
    return (test(v.col, F.lit(operand)))


def among(v: Value, operand) -> Column:
    if not isinstance(operand, list):
        raise BadSpec("$in takes a list")
    if v.is_null or not operand:
        return F.lit(False)
    if v.is_array:
        return (F.exists(v.col, lambda e: reduce(lambda a, b: a | b, (equals(Value(e, v.element), x) for x in operand))))
    plain = (v.is_text and all(isinstance(x, str) for x in operand)) or (isinstance(v.dtype, T.IntegralType) and all(isinstance(x, int) and not isinstance(x, bool) for x in operand))
    if plain:
        return (v.col.isin(operand))
    return reduce(lambda a, b: a | b, (equals(v, x) for x in operand))


OPERATORS = {
    "$gt": lambda v, x: ordered(v, x, lambda a, b: a > b),
    "$gte": lambda v, x: ordered(v, x, lambda a, b: a >= b),
    "$lt": lambda v, x: ordered(v, x, lambda a, b: a < b),
    "$lte": lambda v, x: ordered(v, x, lambda a, b: a <= b),
    "$ne": lambda v, x: F.lit(False) if v.is_null else v.col.isNotNull() & ~F.coalesce(equals(v, x), F.lit(False)),
    "$in": among,
}


def compile_filter(spec: dict, scope: Scope) -> Column:
    """All keys must hold; null means no. Unknown operators raise instead of matching nothing."""
    if not isinstance(spec, dict):
        raise BadSpec("a filter is a document")
    tests = []
    for key, cond in spec.items():
        if key == "$expr":
            tests.append(V.truthy(compile_expr(cond, scope)))
        elif key.startswith("$"):
            raise UnsupportedOperator(f"filter {key}")
        elif isinstance(cond, dict) and any(k.startswith("$") for k in cond):
            v = scope.path(key)
            for name, operand in cond.items():
                if name not in OPERATORS:
                    raise UnsupportedOperator(f"filter {name}")
                tests.append(OPERATORS[name](v, operand))
        else:
            tests.append(equals(scope.path(key), cond))
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


