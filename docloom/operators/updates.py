"""Update documents to projections over the rows they match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import BadSpec, UnsupportedOperator
from docloom.functions import values as V
from docloom.functions.values import Scope, Value
from docloom.operators.stages import without, written


def is_replacement(update: dict) -> bool:
    return not any(k.startswith("$") for k in update)


def incremented(v: Value, by) -> Value:
    """A missing or non-numeric field counts as 0; whole numbers stay whole and widen on overflow, any fraction makes a double."""
    d = V.constant(by)
    if not d.is_number:
        raise BadSpec("$inc takes numbers")
    if isinstance(d.dtype, T.IntegralType) and (isinstance(v.dtype, T.IntegralType) or not v.is_number):
        own = v.col.cast("long") if v.is_number else F.lit(0).cast("long")
        return Value(F.coalesce(own, F.lit(0).cast("long")) + d.col, V.LONG)
    return Value(F.coalesce(V.number(v) if v.is_number else F.lit(0.0), F.lit(0.0)) + d.col.cast("double"), V.DOUBLE)


def appended(v: Value, x, once: bool) -> Value:
    new = V.constant(x)
    if v.is_null:
        return V.array_of([new])
    base = v if v.is_array else Value(F.when(v.col.isNotNull(), F.array(v.col)), T.ArrayType(v.dtype))
    kind = V.common([base.element, new.dtype])
    arr, item = V.to(base, T.ArrayType(kind)), V.to(new, kind)
    held = F.coalesce(arr.col, F.array().cast(T.ArrayType(kind)))
    grown = F.concat(held, F.array(item.col))
    if once:
        grown = F.when(F.exists(held, lambda e: V.same(Value(e, kind), item)), held).otherwise(grown)
    return Value(grown, T.ArrayType(kind))


def updated(schema: T.StructType, update: dict) -> dict[str, Value]:
    """Every field of a row after the update."""
    scope = Scope(schema)
    now = {f.name: scope.path(f.name) for f in schema.fields}
    if is_replacement(update):
        kept = {"_id": now["_id"]} if "_id" in now else {}
        gone = {n: Value(F.lit(None).cast(v.dtype), v.dtype) for n, v in now.items() if n != "_id" and n not in update}
        return {**kept, **{k: V.constant(x) for k, x in update.items() if k != "_id"}, **gone}
    for op, fields in update.items():
        if op not in ("$set", "$unset", "$inc", "$push", "$addToSet"):
            raise UnsupportedOperator(f"update {op}")
        for path, x in fields.items():
            first, *rest = path.split(".")
            if path == "_id":
                raise BadSpec("_id does not change")
            if op == "$unset":
                if first in now:
                    left = without(now[first], rest) if rest else Value(F.lit(None).cast(now[first].dtype), now[first].dtype)
                    if left is not None:
                        now[first] = left
                continue
            old = V.walk(now[first], rest) if first in now else V.nothing()
            new = V.constant(x) if op == "$set" else incremented(old, x) if op == "$inc" else appended(old, x, op == "$addToSet")
            now[first] = written(now.get(first), rest, new)
    return now


def applied(schema: T.StructType, update: dict, hit: Column) -> dict[str, Value]:
    """Every field after the update where ``hit`` holds, and as before elsewhere, in a type that takes both."""
    scope = Scope(schema)
    out = {}
    for name, new in updated(schema, update).items():
        old = scope.path(name)
        if new.is_null and old.is_null:
            new = Value(F.lit(None).cast("string"), V.STRING)
        kind = V.common([old.dtype, new.dtype])
        if old.is_number and new.is_number and isinstance(old.dtype, T.IntegralType) and isinstance(new.dtype, T.LongType):
            kind = V.LONG if not isinstance(old.dtype, T.LongType) else old.dtype
        out[name] = Value(F.when(hit, V.to(new, kind).col).otherwise(V.to(old, kind).col), kind)
    return out


def upsert_base(filter_: dict) -> dict:
    """A document from a filter's equality terms."""
    base: dict = {}
    for path, x in filter_.items():
        if path.startswith("$") or (isinstance(x, dict) and any(k.startswith("$") for k in x)):
            continue
        here = base
        *parents, last = path.split(".")
        for p in parents:
            here = here.setdefault(p, {})
        here[last] = x
    return base


def upserted(filter_: dict, update: dict) -> dict:
    """The document that an upsert without a match inserts."""
    doc = upsert_base(filter_)
    if is_replacement(update):
        return {**({"_id": doc["_id"]} if "_id" in doc else {}), **update}
    for op, fields in update.items():
        for path, x in fields.items():
            *parents, last = path.split(".")
            here = doc
            for p in parents:
                here = here.setdefault(p, {})
            if op == "$set":
                here[last] = x
            elif op == "$inc":
                here[last] = here.get(last, 0) + x
            elif op in ("$push", "$addToSet"):
                held = here.setdefault(last, [])
                if op == "$push" or x not in held:
                    held.append(x)
            elif op == "$unset":
                here.pop(last, None)
            else:
                raise UnsupportedOperator(f"update {op}")
    return doc
