"""Expression documents to typed columns: references, logic, arithmetic, text, objects and conversion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import BadSpec, UnsupportedOperator
from docloom.functions import values as V
from docloom.functions.values import BOOL, DOUBLE, LONG, STRING, TIME, Scope, Value

#: Compilers by operator; the other modules of this package add theirs.
OPERATORS: dict[str, Callable[[object, Scope], Value]] = {}


def op(*names: str):
    def add(f):
        for name in names:
            OPERATORS[name] = f
        return f

    return add


def compile_expr(spec, scope: Scope) -> Value:
    """A document with one key that starts with ``$`` is an operator; text that starts with ``$`` a reference; all else a literal."""
    if isinstance(spec, str) and spec.startswith("$$"):
        name, *rest = spec[2:].split(".")
        if name in scope.names:
            return V.walk(scope.names[name], rest)
        if name in ("ROOT", "CURRENT"):
            return V.walk(scope.root(), rest)
        return V.nothing()
    if isinstance(spec, str) and spec.startswith("$"):
        return scope.path(spec[1:])
    if isinstance(spec, dict) and len(spec) == 1:
        (name, arg), *_ = spec.items()
        if name.startswith("$"):
            if name not in OPERATORS:
                raise UnsupportedOperator(f"expression {name}")
            return OPERATORS[name](arg, scope)
    return V.constant(spec)


def many(arg, scope: Scope, least: int = 0, most: int | None = None) -> list[Value]:
    """Arguments of an operator that takes a list."""
    items = arg if isinstance(arg, list) else [arg]
    if len(items) < least or (most is not None and len(items) > most):
        raise BadSpec(f"{len(items)} arguments, {least} to {most or 'any number'} expected")
    return [compile_expr(x, scope) for x in items]


def one(arg, scope: Scope) -> Value:
    if isinstance(arg, list):
        if len(arg) != 1:
            raise BadSpec("one argument expected")
        arg = arg[0]
    return compile_expr(arg, scope)


def part(arg, key: str, scope: Scope, default=None) -> Value:
    """Compiled ``arg[key]`` of an operator that takes a document."""
    if not isinstance(arg, dict):
        raise BadSpec("a document expected")
    return compile_expr(arg[key], scope) if key in arg else V.constant(default)


def whole(v: Value) -> Column:
    """As int for lengths and positions, fractions cut; null where it is no number."""
    return V.number(v).try_cast("int")


# --- references and logic ------------------------------------------------------------------------


@op("$literal")
def _literal(arg, scope):
    return V.constant(arg)


@op("$rand")
def _rand(arg, scope):
    return Value(F.rand(), DOUBLE)


@op("$meta")
def _meta(arg, scope):
    if arg != "vectorSearchScore":
        raise UnsupportedOperator(f"$meta {arg}")
    return scope.score or V.nothing()


@op("$let")
def _let(arg, scope):
    return compile_expr(arg["in"], scope.bind(**{k: compile_expr(v, scope) for k, v in arg.get("vars", {}).items()}))


@op("$and")
def _and(arg, scope):
    out = None
    for v in many(arg, scope, 1):
        out = V.truthy(v) if out is None else out & V.truthy(v)
    return Value(out, BOOL)


@op("$or")
def _or(arg, scope):
    out = None
    for v in many(arg, scope, 1):
        out = V.truthy(v) if out is None else out | V.truthy(v)
    return Value(out, BOOL)


@op("$not")
def _not(arg, scope):
    return Value(~V.truthy(one(arg, scope)), BOOL)


def choose(cases: list[tuple[Column, Value]], default: Value) -> Value:
    kind = V.common([v.dtype for _, v in cases] + [default.dtype])
    out = None
    for test, v in cases:
        out = F.when(test, V.to(v, kind).col) if out is None else out.when(test, V.to(v, kind).col)
    return Value(out.otherwise(V.to(default, kind).col), kind)


@op("$cond")
def _cond(arg, scope):
    if isinstance(arg, dict):
        arg = [arg["if"], arg["then"], arg["else"]]
    test, yes, no = many(arg, scope, 3, 3)
    return choose([(V.truthy(test), yes)], no)


@op("$switch")
def _switch(arg, scope):
    cases = [(V.truthy(compile_expr(b["case"], scope)), compile_expr(b["then"], scope)) for b in arg["branches"]]
    return choose(cases, part(arg, "default", scope))


@op("$ifNull")
def _if_null(arg, scope):
    a, b = many(arg, scope, 2)[:2]
    kind = V.common([a.dtype, b.dtype])
    return Value(F.coalesce(V.to(a, kind).col, V.to(b, kind).col), kind)


@op("$cmp")
def _cmp(arg, scope):
    return Value(V.cmp(*many(arg, scope, 2, 2)), LONG)


def _compare(name: str, test):
    @op(name)
    def compiled(arg, scope):
        return Value(test(*many(arg, scope, 2, 2)), BOOL)


_compare("$eq", V.same)
_compare("$ne", lambda a, b: ~V.same(a, b))
_compare("$gt", lambda a, b: V.cmp(a, b) > 0)
_compare("$gte", lambda a, b: V.cmp(a, b) >= 0)
_compare("$lt", lambda a, b: V.cmp(a, b) < 0)
_compare("$lte", lambda a, b: V.cmp(a, b) <= 0)


# --- arithmetic: doubles in, doubles out, null for what is no number ------------------------------


@op("$add")
def _add(arg, scope):
    vs = many(arg, scope, 2)
    times = [v for v in vs if v.is_time]
    if len(times) > 1:
        raise BadSpec("$add takes one date at most")
    total = None
    for v in vs:
        if not v.is_time:
            total = V.number(v) if total is None else total + V.number(v)
    if times:
        return Value(F.timestamp_millis(F.unix_millis(V.time(times[0])) + total.cast("long")), TIME)
    return Value(total, DOUBLE)


@op("$subtract")
def _subtract(arg, scope):
    a, b = many(arg, scope, 2, 2)
    if a.is_time and b.is_time:
        return Value(F.unix_millis(V.time(a)) - F.unix_millis(V.time(b)), LONG)
    if a.is_time:
        return Value(F.timestamp_millis(F.unix_millis(V.time(a)) - V.number(b).cast("long")), TIME)
    return Value(V.number(a) - V.number(b), DOUBLE)


@op("$multiply")
def _multiply(arg, scope):
    out = None
    for v in many(arg, scope, 2):
        out = V.number(v) if out is None else out * V.number(v)
    return Value(out, DOUBLE)


@op("$divide")
def _divide(arg, scope):
    a, b = many(arg, scope, 2, 2)
    return Value(F.try_divide(V.number(a), V.number(b)), DOUBLE)


@op("$mod")
def _mod(arg, scope):
    a, b = many(arg, scope, 2, 2)
    return Value(F.try_mod(V.number(a), V.number(b)), DOUBLE)


def _unary(name: str, f):
    @op(name)
    def compiled(arg, scope):
        return Value(f(V.number(one(arg, scope))), DOUBLE)


_unary("$abs", F.abs)
_unary("$ceil", lambda x: F.ceil(x).cast("double"))
_unary("$floor", lambda x: F.floor(x).cast("double"))
_unary("$sqrt", lambda x: F.when(x >= 0, F.sqrt(x)))
_unary("$exp", F.exp)
_unary("$ln", lambda x: F.when(x > 0, F.log(x)))
_unary("$log10", lambda x: F.when(x > 0, F.log10(x)))


@op("$pow")
def _pow(arg, scope):
    a, b = many(arg, scope, 2, 2)
    return Value(F.pow(V.number(a), V.number(b)), DOUBLE)


@op("$log")
def _log(arg, scope):
    x, b = (V.number(v) for v in many(arg, scope, 2, 2))
    return Value(F.when((x > 0) & (b > 0) & (b != 1), F.log(x) / F.log(b)), DOUBLE)


def _digits(arg, scope, half: float):
    x, *p = many(arg, scope, 1, 2)
    x = V.number(x)
    scale = F.pow(F.lit(10.0), whole(p[0]).cast("double")) if p else F.lit(1.0)
    return Value(F.signum(x) * F.floor(F.abs(x) * scale + half).cast("double") / scale, DOUBLE)


@op("$round")
def _round(arg, scope):
    """Half away from zero of the scaled double."""
    return _digits(arg, scope, 0.5)


@op("$trunc")
def _trunc(arg, scope):
    return _digits(arg, scope, 0.0)


# --- text ----------------------------------------------------------------------------------------


@op("$concat")
def _concat(arg, scope):
    return Value(F.concat(*(V.text(v) for v in many(arg, scope, 1))), STRING)


def _text_unary(name: str, f, kind=STRING):
    @op(name)
    def compiled(arg, scope):
        return Value(f(V.text(one(arg, scope))), kind)


_text_unary("$toLower", F.lower)
_text_unary("$toUpper", F.upper)
_text_unary("$strLenCP", lambda s: F.char_length(s).cast("long"), LONG)
_text_unary("$strLenBytes", lambda s: F.octet_length(s).cast("long"), LONG)


def quoted(s: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


@op("$split")
def _split(arg, scope):
    s, sep = many(arg, scope, 2, 2)
    return Value(F.split(V.text(s), quoted(V.text(sep)), -1), T.ArrayType(STRING))


@op("$substrCP")
def _substr_cp(arg, scope):
    s, start, n = many(arg, scope, 3, 3)
    at, size = whole(start), whole(n)
    return Value(F.when(size < 0, F.lit("")).otherwise(F.substring(V.text(s), F.greatest(at, F.lit(0)) + 1, size)), STRING)


@op("$substr", "$substrBytes")
def _substr_bytes(arg, scope):
    s, start, n = many(arg, scope, 3, 3)
    at, size = whole(start), whole(n)
    cut = F.substring(F.encode(V.text(s), "utf-8"), F.greatest(at, F.lit(0)) + 1, size).cast("string")
    return Value(F.when(size < 0, F.lit("")).otherwise(cut), STRING)


@op("$indexOfCP")
def _index_of_cp(arg, scope):
    s, sub, *bounds = many(arg, scope, 2, 4)
    s, sub = V.text(s), V.text(sub)
    start = whole(bounds[0]) if bounds else F.lit(0)
    end = F.least(whole(bounds[1]), F.char_length(s)) if len(bounds) > 1 else F.char_length(s)
    at = F.instr(F.substring(s, start + 1, F.greatest(end - start, F.lit(0))), sub)
    return Value(F.when(s.isNull(), None).when(at > 0, at - 1 + start).otherwise(F.lit(-1)).cast("long"), LONG)


@op("$indexOfBytes")
def _index_of_bytes(arg, scope):
    s, sub, *bounds = many(arg, scope, 2, 4)
    s, sub = V.text(s), V.text(sub)
    start = whole(bounds[0]) if bounds else F.lit(0)
    end = F.least(whole(bounds[1]), F.octet_length(s)) if len(bounds) > 1 else F.octet_length(s)
    window = F.substring(F.encode(s, "utf-8"), start + 1, F.greatest(end - start, F.lit(0))).cast("string")
    at = F.instr(window, sub)
    before = F.octet_length(F.substring(window, F.lit(1), at - 1))
    return Value(F.when(s.isNull(), None).when(at > 0, before + start).otherwise(F.lit(-1)).cast("long"), LONG)


def pattern_of(arg, scope) -> tuple[Column, str]:
    """Input text and the constant pattern with its options in front."""
    regex, options = arg.get("regex"), arg.get("options", "")
    if not isinstance(regex, str):
        raise BadSpec("a regular expression is a constant text")
    if set(options) - set("ims"):
        raise BadSpec(f"options {options}")
    return V.text(part(arg, "input", scope)), f"(?{options}){regex}" if options else regex


@op("$regexMatch")
def _regex_match(arg, scope):
    s, p = pattern_of(arg, scope)
    return Value(F.rlike(s, F.lit(p)), BOOL)


MATCH = T.StructType([T.StructField("match", STRING), T.StructField("idx", LONG)])


@op("$regexFindAll")
def _regex_find_all(arg, scope):
    """Matches with the byte offsets at which they start, from the lengths of what lies between."""
    s, p = pattern_of(arg, scope)
    m, gaps = F.regexp_extract_all(s, F.lit(p), F.lit(0)), F.split(s, p, -1)
    size = lambda a, n: F.octet_length(F.array_join(F.slice(a, F.lit(1), n), ""))
    found = F.transform(m, lambda x, i: F.struct(x.alias("match"), (size(gaps, i + 1) + size(m, i)).cast("long").alias("idx")))
    return Value(found, T.ArrayType(MATCH))


@op("$regexFind")
def _regex_find(arg, scope):
    s, p = pattern_of(arg, scope)
    at = F.regexp_instr(s, F.lit(p))
    return Value(F.when(F.rlike(s, F.lit(p)), F.struct(F.regexp_substr(s, F.lit(p)).alias("match"), F.octet_length(F.substring(s, F.lit(1), at - 1)).cast("long").alias("idx"))), MATCH)


@op("$strcasecmp")
def _strcasecmp(arg, scope):
    a, b = (F.lower(V.text(v)) for v in many(arg, scope, 2, 2))
    return Value(F.when(a == b, 0).when(a < b, -1).when(a > b, 1).cast("long"), LONG)


@op("$replaceAll")
def _replace_all(arg, scope):
    s, find, new = (V.text(part(arg, k, scope)) for k in ("input", "find", "replacement"))
    return Value(F.when(find == "", s).otherwise(F.replace(s, find, new)), STRING)


@op("$replaceOne")
def _replace_one(arg, scope):
    s, find, new = (V.text(part(arg, k, scope)) for k in ("input", "find", "replacement"))
    at = F.instr(s, find)
    return Value(F.when((find == "") | (at == 0), s).otherwise(F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.char_length(find), F.char_length(s)))), STRING)


def _trim(name: str, f, default: str):
    @op(name)
    def compiled(arg, scope):
        if not isinstance(arg, dict) or "input" not in arg:
            arg = {"input": arg}
        chars = V.text(part(arg, "chars", scope)) if "chars" in arg else F.lit(default)
        return Value(f(V.text(part(arg, "input", scope)), chars), STRING)


_trim("$trim", F.btrim, " \t\n\x0b\x0c\r\x85\xa0")
_trim("$ltrim", F.ltrim, " \t\r\n")
_trim("$rtrim", F.rtrim, " \t\r\n")


# --- objects --------------------------------------------------------------------------------------


def field_name(arg) -> str:
    name = arg.get("field")
    if isinstance(name, dict) and set(name) == {"$literal"}:
        name = name["$literal"]
    if not isinstance(name, str):
        raise BadSpec("field is a constant text")
    return name


def fields_of(v: Value) -> dict[str, Value]:
    return {f.name: Value(v.col.getField(f.name), f.dataType) for f in v.dtype.fields} if isinstance(v.dtype, T.StructType) else {}


@op("$getField")
def _get_field(arg, scope):
    if isinstance(arg, str):
        arg = {"field": arg, "input": "$$ROOT"}
    return V.walk(part(arg, "input", scope), [field_name(arg)])


@op("$setField")
def _set_field(arg, scope):
    base, v = part(arg, "input", scope), part(arg, "value", scope)
    if not isinstance(base.dtype, T.StructType):
        return V.nothing()
    made = V.struct_of({**fields_of(base), field_name(arg): v})
    return Value(F.when(base.col.isNotNull(), made.col), made.dtype)


@op("$unsetField")
def _unset_field(arg, scope):
    base = part(arg, "input", scope)
    if not isinstance(base.dtype, T.StructType):
        return V.nothing()
    made = V.struct_of({k: v for k, v in fields_of(base).items() if k != field_name(arg)})
    return Value(F.when(base.col.isNotNull(), made.col), made.dtype)


@op("$mergeObjects")
def _merge_objects(arg, scope):
    """Later documents win where they hold a value; null fields count as absent."""
    if not isinstance(arg, list):
        raise BadSpec("$mergeObjects takes a list")
    merged: dict[str, list[Value]] = {}
    for x in arg:
        v = compile_expr(x, scope)
        for name, own in fields_of(v).items():
            merged.setdefault(name, []).insert(0, own)
    out = {}
    for name, options in merged.items():
        kind = V.common([v.dtype for v in options])
        out[name] = Value(F.coalesce(*(V.to(v, kind).col for v in options)), kind)
    return V.struct_of(out)


@op("$objectToArray")
def _object_to_array(arg, scope):
    v = one(arg, scope)
    if isinstance(v.dtype, T.MapType):
        entries = F.transform(F.map_entries(v.col), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
        return Value(entries, T.ArrayType(T.StructType([T.StructField("k", v.dtype.keyType), T.StructField("v", v.dtype.valueType)])))
    if not isinstance(v.dtype, T.StructType):
        return V.nothing()
    own = fields_of(v)
    kind = V.common([x.dtype for x in own.values()])
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), V.to(x, kind).col.alias("v")) for k, x in own.items()))
    return Value(F.when(v.col.isNotNull(), F.filter(pairs, lambda p: p["v"].isNotNull())), T.ArrayType(T.StructType([T.StructField("k", STRING), T.StructField("v", kind)])))


@op("$arrayToObject")
def _array_to_object(arg, scope):
    """A map; of equal keys the last wins."""
    if isinstance(arg, list) and len(arg) == 1 and (isinstance(arg[0], list | str)):
        arg = arg[0]
    v = compile_expr(arg, scope)
    if isinstance(v.element, T.StructType):
        key, value = (lambda x: V.text(V.walk(Value(x, v.element), ["k"]))), (lambda x: V.walk(Value(x, v.element), ["v"]).col)
        kind = next((f.dataType for f in v.element.fields if f.name == "v"), STRING)
    elif isinstance(v.element, T.ArrayType):
        key, value = (lambda x: F.get(x, 0).cast("string")), (lambda x: F.get(x, 1))
        kind = v.element.elementType
    else:
        return V.nothing()
    entries = F.filter(F.transform(v.col, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))), lambda e: e["key"].isNotNull())
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["key"]))
    return Value(F.map_from_entries(last), T.MapType(STRING, kind))


# --- conversion -------------------------------------------------------------------------------------


def to_long(v: Value) -> Column:
    if isinstance(v.dtype, T.BooleanType):
        return v.col.cast("long")
    if v.is_time:
        return F.unix_millis(V.time(v))
    if v.is_text:
        return F.coalesce(v.col.try_cast("long"), v.col.try_cast("double").try_cast("long"))
    return V.number(v).try_cast("long")


def to_double(v: Value) -> Column:
    if isinstance(v.dtype, T.BooleanType):
        return v.col.cast("double")
    if v.is_time:
        return F.unix_millis(V.time(v)).cast("double")
    return V.number(v)


def to_bool(v: Value) -> Column:
    return F.when(v.col.isNotNull(), V.truthy(v))


@op("$toString")
def _to_string(arg, scope):
    return Value(V.text(one(arg, scope)), STRING)


@op("$toInt", "$toLong")
def _to_long(arg, scope):
    return Value(to_long(one(arg, scope)), LONG)


@op("$toDouble")
def _to_double(arg, scope):
    return Value(to_double(one(arg, scope)), DOUBLE)


@op("$toBool")
def _to_bool(arg, scope):
    return Value(to_bool(one(arg, scope)), BOOL)


@op("$toDate")
def _to_date(arg, scope):
    return Value(V.time(one(arg, scope)), TIME)


@op("$type")
def _type(arg, scope):
    v = one(arg, scope)
    return Value(F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(V.type_name(v))), STRING)


@op("$convert")
def _convert(arg, scope):
    v, target = part(arg, "input", scope), arg.get("to")
    kinds = {"string": (V.text, STRING), "int": (to_long, LONG), "long": (to_long, LONG), "double": (to_double, DOUBLE), "bool": (to_bool, BOOL), "date": (V.time, TIME)}
    if target not in kinds:
        raise UnsupportedOperator(f"$convert to {target}")
    f, kind = kinds[target]
    got, on_error, on_null = Value(f(v), kind), part(arg, "onError", scope), part(arg, "onNull", scope)
    if on_error.is_null and on_null.is_null:
        return got
    out = V.common([kind, on_error.dtype, on_null.dtype])
    return Value(F.when(v.col.isNull(), V.to(on_null, out).col).otherwise(F.coalesce(V.to(got, out).col, V.to(on_error, out).col)), out)
