"""Typed columns: coercion, truth, comparison and paths, all decided by Catalyst type at compile time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLE, LONG, STRING, BOOL, TIME, NULL = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType(), T.TimestampType(), T.NullType()
#: Start of the names of columns that are no fields; the compiler refuses fields so called.
HIDDEN = "~~"
#: How a null renders where values are compared as text.
NIL = "<nil>"


@dataclass(frozen=True)
class Value:
    """A column with its type."""

    col: Column
    dtype: T.DataType

    @property
    def is_null(self) -> bool:
        return isinstance(self.dtype, T.NullType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.dtype, T.NumericType)

    @property
    def is_time(self) -> bool:
        return isinstance(self.dtype, T.TimestampType | T.TimestampNTZType | T.DateType)

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, T.StringType)

    @property
    def is_array(self) -> bool:
        return isinstance(self.dtype, T.ArrayType)

    @property
    def is_document(self) -> bool:
        return isinstance(self.dtype, T.StructType | T.MapType)

    @property
    def element(self) -> T.DataType:
        return self.dtype.elementType if self.is_array else NULL


def nothing() -> Value:
    return Value(F.lit(None), NULL)


@dataclass(frozen=True)
class Scope:
    """What an expression can see: the row's fields, variables, and whether ``$size`` counts a non-array as 0."""

    schema: T.StructType
    names: dict[str, Value] = field(default_factory=dict)
    size_zero: bool = False
    score: Value | None = None

    def bind(self, **names: Value) -> Scope:
        return replace(self, names={**self.names, **names})

    def root(self) -> Value:
        shown = [f for f in self.schema.fields if not f.name.startswith(HIDDEN)]
        return Value(F.struct(*(F.col(f"`{f.name}`") for f in shown)), T.StructType(shown))

    def path(self, path: str) -> Value:
        first, *rest = path.split(".")
        for f in self.schema.fields:
            if f.name == first:
                return walk(Value(F.col(f"`{first}`"), f.dataType), rest)
        return nothing()


def walk(value: Value, parts: Iterable[str]) -> Value:
    """Field of a document; walks through documents only, anything else gives null."""
    for part in parts:
        if isinstance(value.dtype, T.StructType):
            found = next((f for f in value.dtype.fields if f.name == part), None)
            if found is None:
                return nothing()
            value = Value(value.col.getField(part), found.dataType)
        elif isinstance(value.dtype, T.MapType) and isinstance(value.dtype.keyType, T.StringType):
            value = Value(F.try_element_at(value.col, F.lit(part)), value.dtype.valueType)
        else:
            return nothing()
    return value


def constant(x) -> Value:
    """A literal; documents and lists hold literals only."""
    if x is None:
        return nothing()
    if isinstance(x, bool):
        return Value(F.lit(x), BOOL)
    if isinstance(x, int):
        return Value(F.lit(x).cast("long"), LONG)
    if isinstance(x, float):
        return Value(F.lit(x).cast("double"), DOUBLE)
    if isinstance(x, str):
        return Value(F.lit(x), STRING)
    if isinstance(x, Decimal):
        scale = max(0, -x.as_tuple().exponent) if x.is_finite() else 0
        return Value(F.lit(x).cast(f"decimal(38,{min(scale, 38)})"), T.DecimalType(38, min(scale, 38))) if x.is_finite() else Value(F.lit(float(x)), DOUBLE)
    if isinstance(x, dt.datetime):  # without a zone: UTC
        return Value(F.lit(x if x.tzinfo else x.replace(tzinfo=dt.UTC)).cast("timestamp"), TIME)
    if isinstance(x, dt.date):
        return Value(F.lit(dt.datetime(x.year, x.month, x.day, tzinfo=dt.UTC)).cast("timestamp"), TIME)
    if type(x).__name__ == "ObjectId":
        return Value(F.lit(str(x)), STRING)
    if isinstance(x, bytes | bytearray):
        return Value(F.lit(bytes(x)), T.BinaryType())
    if isinstance(x, list | tuple):
        return array_of([constant(v) for v in x])
    if isinstance(x, dict):
        return struct_of({k: constant(v) for k, v in x.items()})
    raise TypeError(f"no literal for {type(x).__name__}")


def array_of(values: list[Value]) -> Value:
    if not values:
        return Value(F.array().cast("array<string>"), T.ArrayType(STRING))
    kind = common([v.dtype for v in values])
    return Value(F.array(*(to(v, kind).col for v in values)), T.ArrayType(kind))


def struct_of(fields: dict[str, Value]) -> Value:
    fields = {k: to(v, STRING) if v.is_null else v for k, v in fields.items()}
    if not fields:
        return Value(F.struct(), T.StructType([]))
    return Value(F.struct(*(v.col.alias(k) for k, v in fields.items())), T.StructType([T.StructField(k, v.dtype) for k, v in fields.items()]))


def common(kinds: list[T.DataType]) -> T.DataType:
    """Type that takes all of these: numbers meet in double (whole ones in long), documents field by field, the rest as text."""
    kinds = [k for k in kinds if not isinstance(k, T.NullType)]
    if not kinds:
        return STRING
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return LONG
    if all(isinstance(k, T.NumericType) for k in kinds):
        return DOUBLE
    if all(isinstance(k, T.TimestampType | T.TimestampNTZType | T.DateType) for k in kinds):
        return TIME
    if all(isinstance(k, T.ArrayType) for k in kinds):
        return T.ArrayType(common([k.elementType for k in kinds]))
    if all(isinstance(k, T.StructType) for k in kinds):
        names = dict.fromkeys(f.name for k in kinds for f in k.fields)
        return T.StructType([T.StructField(n, common([f.dataType for k in kinds for f in k.fields if f.name == n])) for n in names])
    return STRING


def to(v: Value, kind: T.DataType) -> Value:
    """``v`` as ``kind``, where ``kind`` came from ``common``."""
    if v.dtype == kind:
        return v
    if v.is_null:
        return Value(F.lit(None).cast(kind), kind)
    if isinstance(kind, T.StringType):
        return Value(text(v), STRING)
    if isinstance(kind, T.StructType) and isinstance(v.dtype, T.StructType):
        own = {f.name: Value(v.col.getField(f.name), f.dataType) for f in v.dtype.fields}
        made = F.struct(*(to(own.get(f.name, nothing()), f.dataType).col.alias(f.name) for f in kind.fields))
        return Value(F.when(v.col.isNotNull(), made), kind)
    if isinstance(kind, T.ArrayType) and v.is_array:
        return Value(F.transform(v.col, lambda x: to(Value(x, v.element), kind.elementType).col), kind)
    if isinstance(kind, T.TimestampType) and v.is_time:
        return Value(instant(v), kind)
    return Value(v.col.try_cast(kind), kind)


def number(v: Value) -> Column:
    """As double; text counts where it is a number, anything else is null."""
    if v.is_number:
        return v.col.cast("double")
    if v.is_text:
        return v.col.try_cast("double")
    return F.lit(None).cast("double")


#: Milliseconds of a day.
DAY = 86_400_000


def instant(v: Value) -> Column:
    """A time as a point in time, whatever the session's zone: dates and times without a zone are UTC."""
    if isinstance(v.dtype, T.TimestampNTZType):
        t = v.col
        return F.make_timestamp(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.extract(F.lit("SECOND"), t), F.lit("UTC"))
    if isinstance(v.dtype, T.DateType):
        return midnight(v.col)
    return v.col


def midnight(day: Column) -> Column:
    """The point in time at which a date starts in UTC."""
    return F.timestamp_millis(F.unix_date(day).cast("long") * DAY)


def day_of(t: Column) -> Column:
    """The date of a point in time in UTC."""
    return F.date_from_unix_date(F.floor(F.unix_millis(t) / DAY).cast("int"))


def clock(t: Column, span: int, of: int) -> Column:
    """Whole units of ``span`` milliseconds within the last ``of``, in UTC."""
    return F.floor(F.pmod(F.unix_millis(t), F.lit(of).cast("long")) / span).cast("long")


#: Letters of date formats and what they stand for, from a point in time and its date in UTC.
LETTERS = {
    "%Y": (4, lambda t, d: F.year(d)), "%m": (2, lambda t, d: F.month(d)), "%d": (2, lambda t, d: F.dayofmonth(d)),
    "%H": (2, lambda t, d: clock(t, 3_600_000, DAY)), "%M": (2, lambda t, d: clock(t, 60_000, 3_600_000)), "%S": (2, lambda t, d: clock(t, 1000, 60_000)), "%L": (3, lambda t, d: clock(t, 1, 1000)),
}


def formatted(t: Column, parts: list[str]) -> Column:
    """Text of a point in time in UTC from letters as in LETTERS, ``%z`` and plain text."""
    day = day_of(t)

    def piece(p: str) -> Column:
        if p == "%z":
            return F.lit("+0000")
        if p not in LETTERS:
            return F.lit(p)
        width, f = LETTERS[p]
        n = f(t, day).cast("string")
        return F.lpad(n, F.greatest(F.length(n), F.lit(width)), F.lit("0"))

    return F.when(t.isNotNull(), F.concat(*(piece(p) for p in parts)) if parts else F.lit(""))


def iso(v: Value) -> Column:
    return formatted(instant(v), ["%Y", "-", "%m", "-", "%d", "T", "%H", ":", "%M", ":", "%S", ".", "%L", "Z"])


def text(v: Value) -> Column:
    """As text; whole doubles without a fraction, times in ISO form, documents and arrays as JSON."""
    if v.is_text:
        return v.col
    if v.is_null:
        return F.lit(None).cast("string")
    if isinstance(v.dtype, T.DoubleType | T.FloatType):
        whole = v.col.try_cast("long")
        return F.when((v.col == whole.cast("double")) & (F.abs(v.col) < float(1 << 53)), whole.cast("string")).otherwise(v.col.cast("string"))
    if v.is_time:
        return iso(v)
    if v.is_array or v.is_document:
        return F.to_json(v.col)
    return v.col.cast("string")


def truthy(v: Value) -> Column:
    """Null, false, 0 and empty text are false, all else is true; never null."""
    if v.is_null:
        return F.lit(False)
    if isinstance(v.dtype, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if v.is_number:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.is_text:
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def _three(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(0)).when(a < b, F.lit(-1)).otherwise(F.lit(1))


def cmp(a: Value, b: Value) -> Column:
    """-1, 0 or 1 as long, never null. Numbers (also in text) compare as numbers, all else as text; null renders as text of its own, so it lies above numbers and times and below letters."""
    plain = (a.is_number and b.is_number) or (a.is_time and b.is_time)
    if plain:
        exact = isinstance(a.dtype, T.IntegralType) and isinstance(b.dtype, T.IntegralType)
        x, y = (a.col, b.col) if exact else (number(a), number(b)) if a.is_number else (instant(a), instant(b))
        out = F.when(x.isNull() & y.isNull(), F.lit(0)).when(x.isNull(), F.lit(1)).when(y.isNull(), F.lit(-1)).otherwise(_three(x, y))
    else:
        x, y = F.coalesce(text(a), F.lit(NIL)), F.coalesce(text(b), F.lit(NIL))
        out = _three(x, y)
        if (a.is_number or a.is_text) and (b.is_number or b.is_text):
            m, n = number(a), number(b)
            out = F.when(m.isNotNull() & n.isNotNull(), _three(m, n)).otherwise(out)
    return out.cast("long")


def same(a: Value, b: Value) -> Column:
    """Whether ``cmp`` is 0, in a form that joins and filters can use."""
    if a.is_null and b.is_null:
        return F.lit(True)
    if isinstance(a.dtype, T.IntegralType) and isinstance(b.dtype, T.IntegralType):
        return a.col.eqNullSafe(b.col)  # a double holds no long above 2^53
    if a.is_number and b.is_number:
        return number(a).eqNullSafe(number(b))
    if a.dtype == b.dtype and (a.is_time or isinstance(a.dtype, T.BooleanType)):
        return a.col.eqNullSafe(b.col)
    if a.is_null or b.is_null:
        return a.col.isNull() & b.col.isNull()
    return cmp(a, b) == 0


def when_text(s: Column) -> Column:
    """Time from ISO text or a date, in UTC where no zone is given; else null."""
    zoned = F.rlike(s, F.lit("[0-9]([Zz]| ?UTC| ?GMT|[+-][0-9]{2}:?[0-9]{2})$")) & F.contains(s, F.lit(":"))
    day = F.rlike(s, F.lit("^ *[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} *$"))
    return F.try_to_timestamp(F.when(zoned, s).when(day, F.concat(F.trim(s), F.lit("T00:00:00Z"))).otherwise(F.concat(s, F.lit("Z"))))


def time(v: Value) -> Column:
    """As UTC time: times, ISO text, or seconds (milliseconds above 10^12) since 1970."""
    if v.is_time:
        return instant(v)
    if v.is_text:
        return when_text(v.col)
    if v.is_number:
        n = v.col.cast("double")
        return F.when(F.abs(n) > 1e12, F.timestamp_millis(n.cast("long"))).otherwise(F.timestamp_millis((n * 1000).cast("long")))
    return F.lit(None).cast("timestamp")


def type_name(v: Value) -> str:
    """Name of the static type."""
    d = v.dtype
    for kinds, name in (((T.BooleanType,), "bool"), ((T.StringType,), "string"), ((T.LongType,), "long"), ((T.IntegralType,), "int"), ((T.DoubleType, T.FloatType), "double"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "date"), ((T.StructType, T.MapType), "object"), ((T.ArrayType,), "array"), ((T.NullType,), "null")):
        if isinstance(d, kinds):
            return name
    return "unknown"
