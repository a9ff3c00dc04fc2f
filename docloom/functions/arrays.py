"""Array and set expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import BadSpec
from docloom.functions import values as V
from docloom.functions.expressions import compile_expr, many, one, op, part, whole
from docloom.functions.values import BOOL, LONG, STRING, Scope, Value


def holds(arr: Value, x: Value) -> Column:
    """Whether an array has an element equal to ``x``; never null."""
    return F.coalesce(F.exists(arr.col, lambda e: V.same(Value(e, arr.element), x)), F.lit(False))


def keyed(v: Value) -> Value:
    """The array with its elements as text, by which sets tell them apart."""
    return v if v.element == STRING else Value(F.transform(v.col, lambda e: F.coalesce(V.text(Value(e, v.element)), F.lit(V.NIL))), T.ArrayType(STRING))


def lined_up(vs: list[Value]) -> list[Value]:
    """Arrays with one element type."""
    kind = V.common([v.element for v in vs])
    return [V.to(v, T.ArrayType(kind)) for v in vs]


@op("$isArray")
def _is_array(arg, scope):
    v = one(arg, scope)
    return Value(v.col.isNotNull() if v.is_array else F.lit(False), BOOL)


@op("$size")
def _size(arg, scope):
    v = one(arg, scope)
    n = F.when(v.col.isNotNull(), F.size(v.col).cast("long")) if v.is_array else F.lit(None).cast("long")
    return Value(F.coalesce(n, F.lit(0).cast("long")) if scope.size_zero else n, LONG)


@op("$in")
def _in(arg, scope):
    x, arr = many(arg, scope, 2, 2)
    if isinstance(arg, list) and isinstance(arg[1], list):
        arr = V.array_of([compile_expr(e, scope) for e in arg[1]])
    if not arr.is_array:
        return Value(F.lit(False), BOOL)
    if x.is_array:
        return Value(F.coalesce(F.arrays_overlap(keyed(x).col, keyed(arr).col), F.lit(False)), BOOL)
    return Value(holds(arr, x), BOOL)


def _truths(name: str, f):
    @op(name)
    def compiled(arg, scope):
        v = compile_expr(arg[0] if isinstance(arg, list) and len(arg) == 1 else arg, scope)
        if not v.is_array:
            return Value(F.lit(None).cast("boolean"), BOOL)
        return Value(f(v.col, lambda e: V.truthy(Value(e, v.element))), BOOL)


_truths("$allElementsTrue", F.forall)
_truths("$anyElementTrue", F.exists)


def at(v: Value, i: Column) -> Value:
    return Value(F.get(v.col, F.when(i < 0, F.size(v.col) + i).otherwise(i)), v.element)


@op("$arrayElemAt")
def _array_elem_at(arg, scope):
    v, i = many(arg, scope, 2, 2)
    return at(v, whole(i)) if v.is_array else V.nothing()


@op("$first")
def _first(arg, scope):
    v = one(arg, scope)
    return at(v, F.lit(0)) if v.is_array else V.nothing()


@op("$last")
def _last(arg, scope):
    v = one(arg, scope)
    return at(v, F.lit(-1)) if v.is_array else V.nothing()


@op("$concatArrays")
def _concat_arrays(arg, scope):
    vs = many(arg, scope, 2)
    if not all(v.is_array for v in vs):
        return V.nothing()
    vs = lined_up(vs)
    return Value(F.concat(*(v.col for v in vs)), vs[0].dtype)


@op("$slice")
def _slice(arg, scope):
    v, *rest = many(arg, scope, 2, 3)
    if not v.is_array:
        return V.nothing()
    size = F.size(v.col)
    if len(rest) == 1:
        n = whole(rest[0])
        start, count = F.when(n < 0, F.greatest(size + n, F.lit(0))).otherwise(F.lit(0)), F.abs(n)
    else:
        p = whole(rest[0])
        start, count = F.when(p < 0, F.greatest(size + p, F.lit(0))).otherwise(F.least(p, size)), F.greatest(whole(rest[1]), F.lit(0))
    return Value(F.slice(v.col, start + 1, count), v.dtype)


@op("$reverseArray")
def _reverse(arg, scope):
    v = one(arg, scope)
    return Value(F.reverse(v.col), v.dtype) if v.is_array else V.nothing()


@op("$range")
def _range(arg, scope):
    a, b, *s = (V.number(v).try_cast("long") for v in many(arg, scope, 2, 3))
    step = F.when(s[0] == 0, F.lit(1).cast("long")).otherwise(s[0]) if s else F.lit(1).cast("long")
    up, down = (step > 0) & (a < b), (step < 0) & (a > b)
    none = F.array().cast("array<bigint>")
    return Value(F.when(up, F.sequence(a, F.when(up, b - 1).otherwise(a), F.when(up, step).otherwise(F.lit(1)))).when(down, F.sequence(a, F.when(down, b + 1).otherwise(a), F.when(down, step).otherwise(F.lit(-1)))).when(a.isNotNull() & b.isNotNull() & step.isNotNull(), none), T.ArrayType(LONG))


def with_element(scope: Scope, name: str, element: Value, index: Column) -> Scope:
    return scope.bind(**{name: element, "this": element, "index": Value(index.cast("long"), LONG)})


def element_type(v: Value, spec, scope: Scope, name: str) -> T.DataType:
    """Type of a lambda's body; types do not depend on which column stands for the element."""
    return compile_expr(spec, with_element(scope, name, Value(F.lit(None).cast(v.element), v.element), F.lit(0))).dtype


@op("$map")
def _map(arg, scope):
    v, name = part(arg, "input", scope), arg.get("as", "this")
    if not v.is_array:
        return V.nothing()
    kind = V.common([element_type(v, arg["in"], scope, name)])
    return Value(F.transform(v.col, lambda x, i: V.to(compile_expr(arg["in"], with_element(scope, name, Value(x, v.element), i)), kind).col), T.ArrayType(kind))


@op("$filter")
def _filter(arg, scope):
    v, name = part(arg, "input", scope), arg.get("as", "this")
    if not v.is_array:
        return V.nothing()
    out = F.filter(v.col, lambda x, i: V.truthy(compile_expr(arg["cond"], with_element(scope, name, Value(x, v.element), i))))
    if "limit" in arg:
        limit = whole(part(arg, "limit", scope))
        out = F.when(limit > 0, F.slice(out, F.lit(1), F.greatest(limit, F.lit(1)))).otherwise(out)
    return Value(out, v.dtype)


@op("$reduce")
def _reduce(arg, scope):
    v, start = part(arg, "input", scope), part(arg, "initialValue", scope)
    if not v.is_array:
        return V.nothing()
    indexed = F.transform(v.col, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))

    def body(value: Value, x: Column, i: Column) -> Value:
        this = Value(x, v.element)
        return compile_expr(arg["in"], scope.bind(value=value, this=this, index=Value(i, LONG)))

    kind = V.common([start.dtype, body(Value(start.col, start.dtype), F.lit(None).cast(v.element), F.lit(0)).dtype])
    return Value(F.aggregate(indexed, V.to(start, kind).col, lambda a, e: V.to(body(Value(a, kind), e["x"], e["i"]), kind).col), kind)


@op("$sortArray")
def _sort_array(arg, scope):
    """Stable; by the elements or one field of them."""
    v, by = part(arg, "input", scope), arg.get("sortBy", 1)
    if not v.is_array:
        return V.nothing()
    path, sign = [], by
    if isinstance(by, dict):
        if len(by) != 1:
            raise BadSpec("$sortArray sorts by one field")
        (name, sign), *_ = by.items()
        path = name.split(".")
    key = lambda x: V.walk(Value(x, v.element), path)
    placed = F.transform(v.col, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def order(a, b):
        c = V.cmp(key(a["x"]), key(b["x"])).cast("int") * (-1 if sign == -1 else 1)
        return F.when(c != 0, c).otherwise(F.when(a["i"] < b["i"], F.lit(-1)).otherwise(F.lit(1)))

    return Value(F.transform(F.array_sort(placed, order), lambda e: e["x"]), v.dtype)


@op("$zip")
def _zip(arg, scope):
    vs = [compile_expr(x, scope) for x in arg["inputs"]]
    if not vs or not all(v.is_array for v in vs):
        return V.nothing()
    kind = V.common([v.element for v in vs])
    vs = [V.to(v, T.ArrayType(kind)) for v in vs]
    sizes = [F.size(v.col) for v in vs]
    longest = arg.get("useLongestLength", False)
    n = (F.greatest if longest else F.least)(*sizes) if len(vs) > 1 else sizes[0]
    defaults = [V.to(V.constant(d), kind).col for d in arg.get("defaults", [])] if longest else []

    def row(i: Column) -> Column:
        cells = []
        for k, v in enumerate(vs):
            cell = F.get(v.col, i)
            cells.append(F.when(i < sizes[k], cell).otherwise(defaults[k]) if k < len(defaults) else cell)
        return F.array(*cells)

    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), row)).when(n == 0, F.array().cast(T.ArrayType(T.ArrayType(kind))))
    return Value(every, T.ArrayType(T.ArrayType(kind)))


@op("$indexOfArray")
def _index_of_array(arg, scope):
    v, x, *bounds = many(arg, scope, 2, 4)
    if not v.is_array:
        return V.nothing()
    start = F.greatest(whole(bounds[0]), F.lit(0)) if bounds else F.lit(0)
    end = F.least(whole(bounds[1]), F.size(v.col)) if len(bounds) > 1 else F.size(v.col)
    hits = F.transform(v.col, lambda e, i: V.same(Value(e, v.element), x) & (i >= start) & (i < end))
    place = F.array_position(hits, True)
    return Value(F.when(v.col.isNotNull(), F.coalesce(place - 1, F.lit(-1)).cast("long")), LONG)


# --- sets: elements are equal if their texts are ---------------------------------------------------


def only_first(v: Value) -> Column:
    """The array without later elements whose text came before."""
    if v.element == STRING or isinstance(v.element, T.LongType | T.IntegerType | T.BooleanType):
        return F.array_distinct(v.col)
    keys = keyed(v).col
    return F.filter(v.col, lambda e, i: F.array_position(keys, F.coalesce(V.text(Value(e, v.element)), F.lit(V.NIL))) == i + 1)


@op("$setUnion")
def _set_union(arg, scope):
    vs = many(arg, scope, 1)
    if not all(v.is_array for v in vs):
        return V.nothing()
    vs = lined_up(vs)
    return Value(only_first(Value(F.concat(*(v.col for v in vs)), vs[0].dtype)), vs[0].dtype)


@op("$setIntersection")
def _set_intersection(arg, scope):
    """Ordered by text."""
    vs = many(arg, scope, 1)
    if not all(v.is_array for v in vs):
        return V.nothing()
    vs = lined_up(vs)
    out = Value(only_first(vs[0]), vs[0].dtype)
    for v in vs[1:]:
        keys = keyed(v).col
        out = Value(_kept(out, keys), out.dtype)
    by_text = F.transform(F.array_sort(F.transform(out.col, lambda e: F.struct(F.coalesce(V.text(Value(e, out.element)), F.lit(V.NIL)).alias("t"), e.alias("e")))), lambda p: p["e"])
    return Value(by_text, out.dtype)


def _kept(v: Value, keys: Column) -> Column:
    return F.filter(v.col, lambda e: F.array_contains(keys, F.coalesce(V.text(Value(e, v.element)), F.lit(V.NIL))))


@op("$setDifference")
def _set_difference(arg, scope):
    """Keeps what repeats on the left."""
    a, b = many(arg, scope, 2, 2)
    if not (a.is_array and b.is_array):
        return V.nothing()
    keys = keyed(b).col
    return Value(F.filter(a.col, lambda e: ~F.array_contains(keys, F.coalesce(V.text(Value(e, a.element)), F.lit(V.NIL)))), a.dtype)


def _subset(a: Value, b: Value) -> Column:
    return F.size(F.array_except(keyed(a).col, keyed(b).col)) == 0


@op("$setEquals")
def _set_equals(arg, scope):
    a, b = many(arg, scope, 2)[:2]
    if not (a.is_array and b.is_array):
        return Value(F.lit(None).cast("boolean"), BOOL)
    return Value(_subset(a, b) & _subset(b, a), BOOL)


@op("$setIsSubset")
def _set_is_subset(arg, scope):
    a, b = many(arg, scope, 2, 2)
    if not (a.is_array and b.is_array):
        return Value(F.lit(None).cast("boolean"), BOOL)
    return Value(_subset(a, b), BOOL)
