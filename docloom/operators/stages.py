"""Pipeline stages over frames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import BadSpec, UnsupportedOperator
from docloom.functions import values as V
from docloom.functions.expressions import compile_expr
from docloom.functions.values import LONG, Scope, Value
from docloom.operators.filters import compile_filter

#: Hidden columns, all under a prefix that fields may not have: order of rows, score of a vector search, and the row a sub-pipeline runs for.
ORD, SCORE, RID = "~~ord", "~~score", "~~rid"


@dataclass(frozen=True)
class Frame:
    """A data frame under a pipeline: its hidden order, the keys every row belongs to, and the variables in sight."""

    df: DataFrame
    catalog: object = None
    names: dict[str, Value] | None = None
    keys: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema.fields if not f.name.startswith(V.HIDDEN)])

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(V.HIDDEN)]

    @property
    def ordered(self) -> bool:
        return ORD in self.df.columns

    def scope(self, size_zero: bool = False) -> Scope:
        score = Value(F.col(SCORE), V.DOUBLE) if SCORE in self.df.columns else None
        return Scope(self.schema, dict(self.names or {}), size_zero, score)

    def with_df(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def select(self, fields: dict[str, Column]) -> Frame:
        return self.with_df(self.df.select(*(F.col(c) for c in self.hidden), *(c.alias(n) for n, c in fields.items())))


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def untyped(v: Value) -> Column:
    """A null without a type becomes text, so that results can be stored."""
    return v.col.cast("string") if v.is_null else v.col


STAGES: dict = {}


def stage(*names: str):
    def add(f):
        for n in names:
            STAGES[n] = f
        return f

    return add


# --- rows and fields ---------------------------------------------------------------------------


@stage("$match")
def match(frame: Frame, spec) -> Frame:
    return frame.with_df(frame.df.where(compile_filter(spec, frame.scope())))


def included(value: Value, tree: dict) -> Value:
    """The part of a document, or of each document of an array, that a tree of names asks for; null where nothing is there."""
    if value.is_array and isinstance(value.element, T.StructType):
        kind = included(Value(F.lit(None).cast(value.element), value.element), tree).dtype
        return Value(F.transform(value.col, lambda x: included(Value(x, value.element), tree).col), T.ArrayType(kind))
    if not isinstance(value.dtype, T.StructType):
        return V.nothing()
    out = {}
    for name, sub in tree.items():
        own = V.walk(value, [name])
        if not own.is_null:
            out[name] = own if sub is None else included(own, sub)
    made = V.struct_of(out)
    return Value(F.when(value.col.isNotNull(), made.col), made.dtype)


@stage("$project")
def project(frame: Frame, spec) -> Frame:
    """Fields asked for with 1, and computed ones; ``_id`` is not implicit. Only zeros: those fields go."""
    if not isinstance(spec, dict) or not spec:
        raise BadSpec("$project takes a document")
    scope = frame.scope(size_zero=True)
    off = lambda x: x is False or (isinstance(x, int | float) and not isinstance(x, bool) and x == 0)
    if all(off(x) for x in spec.values()):
        return unset(frame, list(spec))
    out: dict[str, Value] = {}
    trees: dict[str, dict] = {}
    for name, x in spec.items():
        if x is True or (isinstance(x, int | float) and not isinstance(x, bool) and x == 1):
            first, *rest = name.split(".")
            if not rest:
                if first in frame.columns:
                    out[first] = scope.path(first)
                continue
            tree = trees.setdefault(first, {})
            out.setdefault(first, V.nothing())
            for p in rest[:-1]:
                tree = tree.setdefault(p, {})
            tree[rest[-1]] = None
        elif isinstance(x, int | float | bool):
            continue
        else:
            out[name] = compile_expr(x, scope)
    for first, tree in trees.items():
        if first in frame.columns:
            out[first] = included(scope.path(first), tree)
        else:
            out.pop(first)
    return frame.select({n: untyped(v) for n, v in out.items()})


def written(value: Value | None, parts: list[str], new: Value) -> Value:
    """A document with one field, however deep, set; parents that are no documents are made."""
    if not parts:
        return new
    own = {f.name: Value(value.col.getField(f.name), f.dataType) for f in value.dtype.fields} if value is not None and isinstance(value.dtype, T.StructType) else {}
    first, *rest = parts
    own[first] = written(own.get(first), rest, new)
    return V.struct_of(own)


@stage("$addFields", "$set")
def add_fields(frame: Frame, spec) -> Frame:
    """All expressions see the rows as they came."""
    scope = frame.scope()
    now = {c: scope.path(c) for c in frame.columns}
    for name, x in spec.items():
        first, *rest = name.split(".")
        now[first] = written(now.get(first), rest, compile_expr(x, scope))
    return frame.select({n: untyped(v) for n, v in now.items()})


def without(value: Value, parts: list[str]) -> Value | None:
    if not parts or not isinstance(value.dtype, T.StructType):
        return None if not parts else value
    own = {f.name: Value(value.col.getField(f.name), f.dataType) for f in value.dtype.fields}
    if parts[0] in own:
        left = without(own[parts[0]], parts[1:])
        own = {k: (left if k == parts[0] else v) for k, v in own.items() if k != parts[0] or left is not None}
    made = V.struct_of(own)
    return Value(F.when(value.col.isNotNull(), made.col), made.dtype)


@stage("$unset")
def unset(frame: Frame, spec) -> Frame:
    names = [spec] if isinstance(spec, str) else list(spec)
    scope = frame.scope()
    now = {c: scope.path(c) for c in frame.columns}
    for name in names:
        first, *rest = name.removeprefix("$").split(".")
        if first in now:
            left = without(now[first], rest)
            now = {k: (left if k == first else v) for k, v in now.items() if k != first or left is not None}
    return frame.select({n: v.col for n, v in now.items()})


def document(frame: Frame, v: Value) -> Frame:
    if not isinstance(v.dtype, T.StructType):
        raise BadSpec("the new root must be a document")
    checked = F.when(v.col.isNull(), F.raise_error(F.lit("the new root must be a document"))).otherwise(v.col)
    df = frame.df.withColumn("~~new", checked)
    return frame.with_df(df.select(*(F.col(c) for c in frame.hidden), *(F.col("~~new").getField(f.name).alias(f.name) for f in v.dtype.fields)))


@stage("$replaceRoot")
def replace_root(frame: Frame, spec) -> Frame:
    return document(frame, compile_expr(spec["newRoot"], frame.scope()))


@stage("$replaceWith")
def replace_with(frame: Frame, spec) -> Frame:
    return document(frame, compile_expr(spec, frame.scope()))


@stage("$unwind")
def unwind(frame: Frame, spec) -> Frame:
    """One row per element; other values stay as one. ``preserveNullAndEmptyArrays`` keeps rows without any."""
    spec = {"path": spec} if isinstance(spec, str) else spec
    path, keep = spec["path"].removeprefix("$"), bool(spec.get("preserveNullAndEmptyArrays", False))
    v = frame.scope().path(path)
    if not v.is_array:
        return frame if keep else frame.with_df(frame.df.where(v.col.isNotNull()))
    explode = F.posexplode_outer if keep else F.posexplode
    df = frame.df.select("*", explode(v.col).alias("~~pos", "~~new"))
    if frame.ordered:
        df = df.withColumn(ORD, F.struct(F.col(ORD).alias("o"), F.coalesce("~~pos", F.lit(0)).alias("p")))
    first, *rest = path.split(".")
    new = written(frame.scope().path(first), rest, Value(F.col("~~new"), v.element))
    return frame.with_df(df.withColumn(first, new.col).drop("~~pos", "~~new"))


# --- order and number of rows ---------------------------------------------------------------------


def direction(x) -> bool:
    return not (isinstance(x, int | float) and x < 0)


def sort_key(v: Value, up: bool) -> list[Column]:
    """Order of a value: numbers and times put nulls last going up, text puts them first; going down is the reverse."""
    if v.is_number or v.is_time:
        return [v.col.asc_nulls_last() if up else v.col.desc_nulls_first()]
    c = V.text(v) if not v.is_text else v.col
    return [c.asc_nulls_first() if up else c.desc_nulls_last()]


def encoded(v: Value, up: bool) -> list[Column]:
    """The same order as values that sort upwards, to be kept in a column."""
    if v.is_number or v.is_time:
        n = v.col if v.is_number else F.unix_micros(V.instant(v))
        return [n.isNull() if up else ~n.isNull(), n if up else -n]
    c = V.text(v) if not v.is_text else v.col
    if up:
        return [~c.isNull(), c]
    points = F.transform(F.split(c, ""), lambda x: -F.ascii(x))
    return [c.isNull(), F.concat(F.filter(points, lambda x: x != 0), F.array(F.lit(1)))]


@stage("$sort")
def sort(frame: Frame, spec) -> Frame:
    """By the keys in the order given; ties keep the order of before where one is known."""
    scope = frame.scope()
    keys = [(scope.path(k) if not (isinstance(d, dict)) else scope.score, direction(d)) for k, d in spec.items()]
    keys = [(v, up) for v, up in keys if v is not None and not v.is_null]
    by = [c for v, up in keys for c in sort_key(v, up)]
    df = frame.df
    if frame.ordered:
        by.append(F.col(ORD).asc())
        flat = [c for v, up in keys for c in encoded(v, up)]
        df = df.withColumn(ORD, F.struct(*(c.alias(f"k{i}") for i, c in enumerate(flat)), F.col(ORD).alias("o")))
        by = [F.col(ORD).asc()]
    if frame.keys:
        return frame.with_df(df)
    return frame.with_df(df.orderBy(*by) if by else df)


def ranked(frame: Frame, test) -> Frame:
    """Keeps rows of each key by their number in its order."""
    by = Window.partitionBy(*frame.keys).orderBy(F.col(ORD).asc() if frame.ordered else F.lit(1))
    return frame.with_df(frame.df.withColumn("~~n", F.row_number().over(by)).where(test(F.col("~~n"))).drop("~~n"))


def counted(x) -> int:
    if isinstance(x, bool) or not isinstance(x, int | float):
        raise BadSpec("a whole number expected")
    return max(0, int(x))


@stage("$limit")
def limit(frame: Frame, spec) -> Frame:
    n = counted(spec)
    return ranked(frame, lambda c: c <= n) if frame.keys else frame.with_df(frame.df.limit(n))


@stage("$skip")
def skip(frame: Frame, spec) -> Frame:
    n = counted(spec)
    return ranked(frame, lambda c: c > n) if frame.keys else frame.with_df(frame.df.offset(n))


@stage("$sample")
def sample(frame: Frame, spec) -> Frame:
    n = counted(spec["size"])
    if frame.keys:
        by = Window.partitionBy(*frame.keys).orderBy(F.rand())
        return frame.with_df(frame.df.withColumn("~~n", F.row_number().over(by)).where(F.col("~~n") <= n).drop("~~n"))
    return frame.with_df(frame.df.orderBy(F.rand()).limit(n))


# --- groups ---------------------------------------------------------------------------------------


def numeric(v: Value) -> Column:
    """For sums: whole numbers as long, others (and text that is a number) as double."""
    return v.col.cast("long") if isinstance(v.dtype, T.IntegralType) else V.number(v)


def in_order(frame: Frame, values: Column) -> Column:
    """Values of a group as a list in the order of rows."""
    if not frame.ordered:
        return F.transform(F.collect_list(F.struct(values.alias("v"))), lambda e: e["v"])
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(ORD).alias("o"), F.struct(values.alias("v")).alias("w")))), lambda e: e["w"]["v"])


def accumulator(name: str, arg, frame: Frame) -> Column:
    scope = frame.scope()
    if name == "$sum" and arg == 1 and not isinstance(arg, bool):
        return F.count(F.lit(1))
    v = compile_expr(arg, scope)
    if name == "$sum":
        return F.sum(numeric(v))
    if name == "$avg":
        return F.avg(V.number(v))
    if name in ("$min", "$max"):
        return (F.min if name == "$min" else F.max)(untyped(v))
    if name in ("$first", "$last"):
        if not frame.ordered:
            return (F.first if name == "$first" else F.last)(untyped(v))
        return (F.min_by if name == "$first" else F.max_by)(untyped(v), F.col(ORD))
    if name == "$push":
        return in_order(frame, untyped(v))
    if name == "$addToSet":
        return F.transform(F.collect_set(F.struct(untyped(v).alias("v"))), lambda e: e["v"])
    raise UnsupportedOperator(f"accumulator {name}")


def group_key(spec, scope: Scope) -> Value:
    """A reference, an operator, a constant, or a document of such."""
    if isinstance(spec, dict) and not (len(spec) == 1 and next(iter(spec)).startswith("$")):
        return V.struct_of({k: group_key(x, scope) for k, x in spec.items()})
    return compile_expr(spec, scope)


@stage("$group")
def group(frame: Frame, spec) -> Frame:
    """Null and missing keys are one group; no rows, no groups."""
    if "_id" not in spec:
        raise BadSpec("$group needs _id")
    key = group_key(spec["_id"], frame.scope())
    aggregates = []
    for name, acc in spec.items():
        if name == "_id":
            continue
        if not isinstance(acc, dict) or len(acc) != 1:
            raise BadSpec(f"{name} takes one accumulator")
        (op, arg), *_ = acc.items()
        aggregates.append(accumulator(op, arg, frame).alias(name))
    if frame.ordered:
        aggregates.append(F.min(ORD).alias(ORD))
    if not aggregates:
        aggregates.append(F.count(F.lit(1)).alias("~~count"))
    out = frame.df.groupBy(*frame.keys, untyped(key).alias("_id")).agg(*aggregates)
    return frame.with_df(out.drop("~~count"))


@stage("$sortByCount")
def sort_by_count(frame: Frame, spec) -> Frame:
    out = group(frame, {"_id": spec, "count": {"$sum": 1}})
    return sort(out, {"count": -1})


@stage("$count")
def count(frame: Frame, spec) -> Frame:
    """One row even for no rows."""
    if not isinstance(spec, str) or not spec:
        raise BadSpec("$count takes a name")
    if frame.keys:
        return frame.with_df(frame.df.groupBy(*frame.keys).agg(F.count(F.lit(1)).alias(spec)))
    return frame.with_df(frame.df.agg(F.count(F.lit(1)).alias(spec)))


def numbered(df: DataFrame, by: list[Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``~~n``, the rows' number from 1 in an order, without gathering them in one task: sorted by range, then numbered from what the partitions before hold."""
    if keys:
        return df.withColumn("~~n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long"))
    from docloom.sources.storage import stored

    placed = stored(df.orderBy(*by).withColumn("~~part", F.spark_partition_id()).withColumn("~~own", F.monotonically_increasing_id()), "numbered")
    rows = placed.withColumn("~~low", F.col("~~own").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("~~part").agg(F.count(F.lit(1)).alias("~~held"))
    before = sizes.withColumn("~~base", F.coalesce(F.sum("~~held").over(Window.orderBy("~~part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("~~part", "~~base")
    out = rows.join(F.broadcast(before), "~~part")  # a row a partition
    return out.withColumn("~~n", F.col("~~base") + F.col("~~low") + 1).drop("~~part", "~~own", "~~low", "~~base")


@stage("$bucketAuto")
def bucket_auto(frame: Frame, spec) -> Frame:
    """Buckets of equal size, the first ones with the rest; ``max`` is the last key within. Equal keys may be parted."""
    if set(spec) - {"groupBy", "buckets"}:
        raise UnsupportedOperator("$bucketAuto takes groupBy and buckets")
    n = counted(spec["buckets"])
    if n < 1:
        raise BadSpec("buckets must be positive")
    key = compile_expr(spec["groupBy"], frame.scope())
    df = frame.df.withColumn("~~key", untyped(key))
    by = [*sort_key(Value(F.col("~~key"), key.dtype if not key.is_null else V.STRING), True), *([F.col(ORD).asc()] if frame.ordered else [])]
    rows = numbered(df, by, frame.keys)
    total = F.count(F.lit(1)).over(Window.partitionBy(*frame.keys)) if frame.keys else None
    if total is not None:
        rows = rows.withColumn("~~all", total)
    else:
        rows = rows.crossJoin(F.broadcast(frame.df.agg(F.count(F.lit(1)).alias("~~all"))))  # one row
    size, rest = F.floor(F.col("~~all") / F.lit(n)), F.col("~~all") % F.lit(n)
    wide = rest * (size + 1)
    place = F.when(F.col("~~n") <= wide, F.floor((F.col("~~n") - 1) / (size + 1))).otherwise(rest + F.floor((F.col("~~n") - 1 - wide) / F.greatest(size, F.lit(1))))
    out = rows.withColumn("~~bucket", place).groupBy(*frame.keys, "~~bucket").agg(F.struct(F.min_by("~~key", "~~n").alias("min"), F.max_by("~~key", "~~n").alias("max")).alias("_id"), F.count(F.lit(1)).alias("count"))
    out = out.withColumnRenamed("~~bucket", ORD) if frame.ordered else out.orderBy("~~bucket").drop("~~bucket")
    return frame.with_df(out)


# --- windows -------------------------------------------------------------------------------------


@stage("$setWindowFields")
def set_window_fields(frame: Frame, spec) -> Frame:
    scope = frame.scope()
    if not isinstance(spec.get("sortBy"), dict) or not spec["sortBy"]:
        raise BadSpec("$setWindowFields needs sortBy")
    (name, d), *_ = spec["sortBy"].items()
    by = sort_key(scope.path(name), direction(d))
    parts = [*(F.col(k) for k in frame.keys), *([untyped(compile_expr(spec["partitionBy"], scope))] if spec.get("partitionBy") is not None else [])]
    ties = [F.col(ORD).asc()] if frame.ordered else []
    window = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(1))
    plain, stable = window.orderBy(*by), window.orderBy(*by, *ties)
    now = {c: q(c) for c in frame.columns}
    for out, fn in spec.get("output", {}).items():
        if not isinstance(fn, dict):
            raise BadSpec(f"{out} takes a function")
        frame_of = fn.get("window")
        (op, arg), *more = [(k, x) for k, x in fn.items() if k != "window"]
        if more:
            raise BadSpec(f"{out} takes one function")
        if op == "$avg":
            if frame_of is not None and frame_of != {"documents": ["unbounded", "current"]}:
                raise UnsupportedOperator("windows run from the first document to the current one")
            c = F.avg(V.number(compile_expr(arg, scope))).over(stable.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        elif op == "$rank":
            c = F.rank().over(plain).cast("long")
        elif op == "$denseRank":
            c = F.dense_rank().over(plain).cast("long")
        elif op == "$documentNumber":
            c = F.row_number().over(stable).cast("long")
        elif op == "$shift":
            v, n = compile_expr(arg["output"], scope), int(arg.get("by", 0))
            default = compile_expr(arg["default"], scope) if "default" in arg else V.nothing()
            kind = V.common([v.dtype, default.dtype])
            place = F.row_number().over(stable) + n
            held = F.count(F.lit(1)).over(window)
            own = V.to(v, kind).col
            c = F.when((place >= 1) & (place <= held), F.lead(own, n).over(stable) if n >= 0 else F.lag(own, -n).over(stable)).otherwise(V.to(default, kind).col)
        else:
            raise UnsupportedOperator(f"window function {op}")
        now[out] = c
    return frame.select(now)


# --- other collections -----------------------------------------------------------------------------


def foreign(frame: Frame, name: str) -> DataFrame:
    if frame.catalog is None:
        raise BadSpec(f"no collection {name}")
    return frame.catalog.frame(name)


def join_key(v: Value) -> Column:
    """What lookups compare: numbers by value, all else by text, null equal to null."""
    return V.text(v)


def row_id(df: DataFrame) -> DataFrame:
    return df.withColumn(RID, F.monotonically_increasing_id())


def renamed(df: DataFrame) -> DataFrame:
    return df.select(*(q(c).alias(f"~~f_{c}") for c in df.columns if not c.startswith(V.HIDDEN)), (F.col(ORD) if ORD in df.columns else F.monotonically_increasing_id()).alias("~~order_there"))


@stage("$lookup")
def lookup(frame: Frame, spec) -> Frame:
    """Equality by value for numbers, else by text; null meets null; an array on either side meets by any element. Of plain fields the foreign side is grouped by key and joined once; with arrays there is one join and one regrouping by row."""
    out = spec["as"]
    if "pipeline" in spec:
        return lookup_pipeline(frame, spec)
    df = foreign(frame, spec["from"])
    schema = T.StructType([f for f in df.schema.fields if not f.name.startswith(V.HIDDEN)])
    right = renamed(df)
    local, there = frame.scope().path(spec["localField"]), walk_renamed(schema, spec["foreignField"])
    whole = isinstance(local.dtype, T.IntegralType) and isinstance(there.dtype, T.IntegralType)

    def side(v: Value) -> Column:
        return F.transform(v.col, lambda x: join_key(Value(x, v.element))) if v.is_array else v.col.cast("long") if whole else join_key(v)

    def exploded(df: DataFrame, v: Value, name: str, outer: bool) -> DataFrame:
        return df.select("*", (F.explode_outer if outer else F.explode)(F.array_distinct(side(v))).alias(name)) if v.is_array else df.withColumn(name, side(v))

    item = F.struct(*(q(f"~~f_{f.name}").alias(f.name) for f in schema.fields))
    keep = [c for c in frame.df.columns if c != out]
    if not local.is_array and not there.is_array:
        # a list for each key of the other side, then one join: every left row moves once
        entry = F.struct(F.col("~~order_there").alias("o"), F.struct(item.alias("d")).alias("w"))
        lists = right.groupBy(side(there).alias("~~g")).agg(F.sort_array(F.collect_list(entry)).alias("~~list"))
        found = F.transform(F.coalesce("~~list", F.array().cast(lists.schema["~~list"].dataType)), lambda e: e["w"]["d"])
        joined = frame.df.join(lists, side(local).eqNullSafe(F.col("~~g")), "left")
        return frame.with_df(joined.select(*(q(c) for c in keep), found.alias(out)))
    left = row_id(frame.df)
    missing = local.col.isNull() if local.is_array else F.lit(False)
    tagged = exploded(left.withColumn("~~none", missing | (F.size(local.col) == 0 if local.is_array else F.lit(False))), local, "~~k", True)
    met = F.col("~~k").eqNullSafe(F.col("~~g"))
    if local.is_array:  # no element is not a null element
        met = met & ~F.col("~~none")
    pairs = tagged.join(exploded(right, there, "~~g", False), met, "left")
    hit = F.when(F.col("~~order_there").isNotNull(), F.struct(F.col("~~order_there").alias("o"), F.struct(item.alias("d")).alias("w")))
    rows = pairs.groupBy(RID).agg(F.first(F.struct(*(q(c) for c in keep))).alias("~~row"), F.sort_array(F.collect_list(hit)).alias("~~list"))
    found = F.array_distinct("~~list") if local.is_array or there.is_array else F.col("~~list")
    return frame.with_df(rows.select(*(F.col("~~row").getField(c).alias(c) for c in keep), F.transform(found, lambda e: e["w"]["d"]).alias(out)))


def walk_renamed(schema: T.StructType, path: str) -> Value:
    first, *rest = path.split(".")
    f = next((f for f in schema.fields if f.name == first), None)
    return V.nothing() if f is None else V.walk(Value(q(f"~~f_{first}"), f.dataType), rest)


def joined_lookup(frame: Frame, spec, keep: bool) -> Frame:
    """``$lookup`` on plain fields directly followed by ``$unwind`` of its list: a join, no lists."""
    df = foreign(frame, spec["from"])
    schema = T.StructType([f for f in df.schema.fields if not f.name.startswith(V.HIDDEN)])
    right = renamed(df)
    local, there = frame.scope().path(spec["localField"]), walk_renamed(schema, spec["foreignField"])
    whole = isinstance(local.dtype, T.IntegralType) and isinstance(there.dtype, T.IntegralType)
    mine, theirs = (local.col.cast("long"), there.col.cast("long")) if whole else (V.number(local), V.number(there)) if local.is_number and there.is_number else (join_key(local), join_key(there))
    item = F.struct(*(q(f"~~f_{f.name}").alias(f.name) for f in schema.fields))
    joined = frame.df.join(right, mine.eqNullSafe(theirs), "left" if keep else "inner")
    rest = [c for c in frame.df.columns if c not in (spec["as"], ORD)]
    order = [F.struct(F.col(ORD).alias("o"), F.col("~~order_there").alias("p")).alias(ORD)] if frame.ordered else []
    return frame.with_df(joined.select(*order, *(q(c) for c in rest), F.when(F.col("~~order_there").isNotNull(), item).alias(spec["as"])))


def plain_lookup(frame: Frame, spec) -> bool:
    if "pipeline" in spec:
        return False
    schema = foreign(frame, spec["from"]).schema
    return not frame.scope().path(spec["localField"]).is_array and not walk_renamed(schema, spec["foreignField"]).is_array


def lookup_pipeline(frame: Frame, spec) -> Frame:
    """The pipeline runs once over all pairs of a left row and the foreign rows, keyed by the left row: sorts, limits and groups work within a key. Equality tests in its first ``$match`` become join conditions. Without variables it runs once for all."""
    from docloom.plans.compiler import run_stages
    from docloom.sources.storage import stored

    steps = spec["pipeline"]
    if not steps:
        raise BadSpec("a lookup's pipeline is not empty")
    let = spec.get("let") or {}
    df = foreign(frame, spec["from"])
    right = Frame(df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id()), frame.catalog)
    scope = frame.scope()
    outer = dict(frame.names or {})
    if not let and not outer:
        got = run_stages(right, steps)
        item = F.struct(*(q(c).alias(c) for c in got.columns))
        order = F.col(ORD) if got.ordered else F.lit(0)
        lists = got.df.agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(item.alias("d")).alias("w")))), lambda e: e["w"]["d"]).alias(spec["as"]))
        keep = [c for c in frame.df.columns if c != spec["as"]]
        return frame.with_df(frame.df.select(*(q(c) for c in keep)).crossJoin(F.broadcast(lists)))  # one row
    names, picks = {}, []
    for k, (name, x) in enumerate(let.items()):
        v = compile_expr(x, scope)
        picks.append(untyped(v).alias(f"~~let{k}_{name}"))
        names[name] = Value(F.col(f"~~let{k}_{name}"), V.STRING if v.is_null else v.dtype)
    left = stored(row_id(frame.df), "lookup")  # read twice, so its row numbers must not change
    tagged = left.select(RID, *frame.keys, *picks)
    first = steps[0].get("$match") if len(steps[0]) == 1 else None
    inner = replace(right, names={**outer, **names}, keys=(RID,))
    if first is not None:
        test = compile_filter(first, inner.scope())
        pairs, rest = tagged.join(right.df, test), steps[1:]
    else:
        pairs, rest = tagged.crossJoin(right.df), steps
    got = run_stages(replace(inner, df=pairs), rest)
    item = F.struct(*(q(c).alias(c) for c in got.columns))
    order = F.col(ORD) if got.ordered else F.lit(0)
    lists = got.df.groupBy(RID).agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(item.alias("d")).alias("w")))), lambda e: e["w"]["d"]).alias("~~list"))
    kind = T.ArrayType(got.schema)
    keep = [c for c in frame.df.columns if c != spec["as"]]
    otherwise = F.array().cast(kind)
    counter = next((s["$count"] for s in reversed(steps) if "$count" in s), None)
    if counter is not None and steps[-1].get("$count") == counter:  # a count of nothing is one row with 0
        otherwise = F.array(F.struct(F.lit(0).cast("long").alias(counter)))
    joined = left.join(lists, RID, "left")
    return frame.with_df(joined.select(*(q(c) for c in keep), F.coalesce(F.col("~~list"), otherwise).alias(spec["as"])))


@stage("$graphLookup")
def graph_lookup(frame: Frame, spec) -> Frame:
    """Breadth first from the start values. A round joins the frontier's values to the foreign rows, keeps what the restriction lets pass, and goes on with values not seen for that row; every round is written out, so its plan does not grow. Without ``maxDepth`` the walk ends when nothing is new. Rows come by depth, then in foreign order. Null starts reach nothing."""
    from docloom.sources.storage import stored

    df = foreign(frame, spec["from"])
    schema = T.StructType([f for f in df.schema.fields if not f.name.startswith(V.HIDDEN)])
    depth_name = spec.get("depthField")
    right = df
    if "restrictSearchWithMatch" in spec:
        right = right.where(compile_filter(spec["restrictSearchWithMatch"], Scope(schema)))
    right = renamed(right)
    to_v = walk_renamed(schema, spec["connectToField"])
    from_v = walk_renamed(schema, spec["connectFromField"])

    def values(v: Value) -> Column:
        return F.transform(v.col, lambda x: join_key(Value(x, v.element))) if v.is_array else F.array(join_key(v))

    edges = right.withColumn("~~next", values(from_v)).withColumn("~~g", F.explode(F.array_distinct(values(to_v)))).where(F.col("~~g").isNotNull())
    left = stored(row_id(frame.df), "graph")  # read twice, so its row numbers must not change
    start = compile_expr(spec["startWith"], frame.scope())
    frontier = left.select(RID, F.explode(values(start)).alias("~~value")).where(F.col("~~value").isNotNull()).distinct()
    frontier = stored(frontier.withColumn("~~depth", F.lit(0).cast("long")), "graph")
    seen, found, depth = frontier.select(RID, "~~value"), [], 0  # grows by one scan a round
    most = spec.get("maxDepth")
    while True:
        step = stored(frontier.join(edges, F.col("~~value") == F.col("~~g")).drop("~~g"), "graph")
        found.append(step.drop("~~value", "~~next"))
        if most is not None and depth >= most:
            break
        new = step.select(RID, F.explode("~~next").alias("~~value")).where(F.col("~~value").isNotNull()).distinct().join(seen, [RID, "~~value"], "left_anti")
        depth += 1
        frontier = stored(new.withColumn("~~depth", F.lit(depth).cast("long")), "graph")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select(RID, "~~value"))
    rows = reduce(DataFrame.unionByName, found)
    best = rows.groupBy(RID, "~~order_there").agg(F.min("~~depth").alias("~~depth"), *(F.first(f"~~f_{f.name}").alias(f"~~f_{f.name}") for f in schema.fields))
    item = F.struct(*(q(f"~~f_{f.name}").alias(f.name) for f in schema.fields), *([F.col("~~depth").alias(depth_name)] if depth_name else []))
    kind = T.StructType([*schema.fields, *([T.StructField(depth_name, LONG)] if depth_name else [])])
    lists = best.groupBy(RID).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("~~depth").alias("d"), F.col("~~order_there").alias("o"), F.struct(item.alias("x")).alias("w")))), lambda e: e["w"]["x"]).alias("~~list"))
    keep = [c for c in frame.df.columns if c != spec["as"]]
    joined = left.join(lists, RID, "left")
    return frame.with_df(joined.select(*(q(c) for c in keep), F.coalesce(F.col("~~list"), F.array().cast(T.ArrayType(kind))).alias(spec["as"])))


@stage("$unionWith")
def union_with(frame: Frame, spec) -> Frame:
    """All rows of both, the base's first."""
    from docloom.plans.compiler import run_stages

    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = Frame(foreign(frame, spec.get("coll") or spec["from"]), frame.catalog)
    if spec.get("pipeline"):
        other = run_stages(other, spec["pipeline"])
    mine, theirs = frame.scope(), other.scope()
    names = list(dict.fromkeys([*frame.columns, *other.columns]))

    def side(f: Frame, s: Scope, t: Scope) -> DataFrame:
        cols = []
        for n in names:
            own, its = s.path(n), t.path(n)
            kind = V.common([own.dtype, its.dtype])
            cols.append(V.to(own, kind).col.alias(n))
        return f.df.select(*cols)

    out = side(frame, mine, theirs).unionByName(side(other, theirs, mine))
    return frame.with_df(out.withColumn(ORD, F.monotonically_increasing_id()) if frame.ordered else out)


@stage("$facet")
def facet(frame: Frame, spec) -> Frame:
    """Every pipeline over the same rows; one row of lists."""
    from docloom.plans.compiler import run_stages

    out = None
    for name, steps in spec.items():
        got = run_stages(frame, steps)
        item = F.struct(*(q(c).alias(c) for c in got.columns))
        order = F.col(ORD) if got.ordered else F.lit(0)
        one = got.df.agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(item.alias("d")).alias("w")))), lambda e: e["w"]["d"]).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return frame.with_df(out)


@stage("$collStats")
def coll_stats(frame: Frame, spec) -> Frame:
    """A placeholder of zeros."""
    unknown = set(spec) - {"latencyStats", "storageStats", "count"}
    if unknown:
        raise UnsupportedOperator(f"$collStats {sorted(unknown)}")
    zero = F.lit(0).cast("long")
    parts = []
    if "latencyStats" in spec:
        parts.append(F.struct(*(F.struct(zero.alias("latency"), zero.alias("ops")).alias(k) for k in ("reads", "writes", "commands"))).alias("latencyStats"))
    if "storageStats" in spec:
        parts.append(F.struct(*(zero.alias(k) for k in ("size", "count", "storageSize", "nindexes", "totalIndexSize"))).alias("storageStats"))
    if "count" in spec:
        parts.append(zero.alias("count"))
    return frame.with_df(frame.df.sparkSession.range(1).select(*(parts or [zero.alias("ok")])))


@stage("$vectorSearch")
def vector_search(frame: Frame, spec) -> Frame:
    """Exact scan: the ``limit`` rows of highest similarity; vectors of another length, with nulls or without length are passed over."""
    v, query = frame.scope().path(spec["path"]), [float(x) for x in spec["queryVector"]]
    n, kind = counted(spec.get("limit", 10)), spec.get("similarity", "cosine")
    if not v.is_array or not isinstance(v.element, T.NumericType):
        raise BadSpec(f"{spec['path']} is no vector")
    lit = F.array(*(F.lit(x) for x in query))
    xs = F.transform(v.col, lambda x: x.cast("double"))
    fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = fold(F.zip_with(xs, lit, lambda a, b: a * b))
    norm2 = fold(F.transform(xs, lambda a: a * a))
    own = sum(x * x for x in query)
    good = (F.size(v.col) == len(query)) & F.forall(v.col, lambda x: x.isNotNull())
    if kind == "cosine":
        score, good = F.try_divide(dot, F.sqrt(norm2) * F.lit(own**0.5)), good & (norm2 > 0) & F.lit(own > 0)
    elif kind in ("dot", "dotProduct", "dot_product"):
        score = dot
    elif kind in ("euclidean", "l2"):
        score = 1 / (1 + F.sqrt(fold(F.zip_with(xs, lit, lambda a, b: (a - b) * (a - b)))))
    else:
        raise UnsupportedOperator(f"similarity {kind}")
    df = frame.df.where(F.coalesce(good, F.lit(False))).withColumn(SCORE, score)
    ties = [F.col(ORD).asc()] if frame.ordered else []
    df = df.orderBy(F.col(SCORE).desc(), *ties).limit(n)
    if frame.ordered:
        df = df.withColumn(ORD, F.struct((-F.col(SCORE)).alias("s"), F.col(ORD).alias("o")))
    return frame.with_df(df)
