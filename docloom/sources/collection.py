"""The document engine: databases of collections with find, count, aggregate, insert, update and delete.

A collection is a Parquet snapshot and what was inserted since. Updates and
deletes make a new snapshot in the shared folder and swap it in, inserts write
their own rows only; reads of a plan made before keep the old rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import BadSpec
from docloom.functions import values as V
from docloom.functions.values import Scope, Value
from docloom.operators import updates as U
from docloom.operators.filters import compile_filter
from docloom.plans.compiler import compile_pipeline
from docloom.sources.storage import stored


#: Inserts after which a collection is written as one again.
MOST_PARTS = 32


class DuplicateKey(ValueError):
    """A unique index would hold a key twice."""


@dataclass
class UpdateResult:
    matched: int
    modified: int
    upserted: object = None


@dataclass
class Engine:
    """Collections by name. ``register`` takes any data frame; ``from_parquet`` every table of a folder."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, str | None] = field(default_factory=dict)
    indexes: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    #: Sets of files of a collection: its snapshot and what was added since.
    parts: dict[str, int] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, key: str | None = None) -> Collection:
        self.tables[name], self.keys[name] = df, key if key or "_id" not in df.columns else "_id"
        return Collection(self, name)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, names: dict[str, str | None]) -> Engine:
        """``names``: the tables and the column that orders each."""
        out = cls(spark)
        for name, key in names.items():
            out.register(name, spark.read.parquet(f"{folder}/{name}.parquet"), key)
        return out

    def has(self, name: str) -> bool:
        return name in self.tables

    def frame(self, name: str) -> DataFrame:
        if name not in self.tables:
            return self.spark.createDataFrame([], T.StructType([T.StructField("_id", T.StringType())]))
        return self.tables[name]

    def collection(self, name: str) -> Collection:
        return Collection(self, name)

    def create(self, name: str) -> Collection:
        if self.has(name):
            raise BadSpec(f"{name} exists")
        return self.register(name, self.frame(name))

    def drop(self, name: str) -> bool:
        self.indexes.pop(name, None)
        self.keys.pop(name, None)
        self.parts.pop(name, None)
        return self.tables.pop(name, None) is not None

    def drop_database(self, db: str) -> int:
        mine = [n for n in self.tables if n.startswith(f"{db}.")]
        for n in mine:
            self.drop(n)
        return len(mine)

    def list_collections(self, db: str | None = None) -> list[str]:
        return sorted(n for n in self.tables if db is None or n.startswith(f"{db}."))

    def stats(self, db: str) -> dict:
        """Collections of a database, their rows and the bytes of these as JSON."""
        each = [self.collection(n).stats() for n in self.list_collections(db)]
        return {"db": db, "collections": len(each), "objects": sum(s["count"] for s in each), "dataSize": sum(s["size"] for s in each)}

    def list_databases(self) -> list[str]:
        return sorted({n.split(".")[0] for n in self.tables if "." in n})


def plain_json(doc: dict) -> str:
    return json.dumps(doc, default=lambda x: x.isoformat() if hasattr(x, "isoformat") else str(x))


def frame_of(spark: SparkSession, docs: list[dict]) -> DataFrame:
    """Documents as rows: a column for each top-level field; a field with several types becomes text."""
    names = list(dict.fromkeys(k for d in docs for k in d))
    kinds = {}
    for n in names:
        vs = [V.constant(d[n]).dtype for d in docs if d.get(n) is not None]
        kinds[n] = V.common(vs)
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])

    def cell(x, kind):
        if x is None:
            return None
        if isinstance(kind, T.StringType) and not isinstance(x, str):
            return plain_json(x) if isinstance(x, dict | list | bool) else str(x)
        if isinstance(kind, T.DoubleType):
            return float(x)
        if isinstance(kind, T.StructType):
            return tuple(cell(x.get(f.name), f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return [cell(y, kind.elementType) for y in x]
        return x

    return spark.createDataFrame([tuple(cell(d.get(n), kinds[n]) for n in names) for d in docs], schema)


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both under one additive schema."""
    sa, sb = Scope(a.schema), Scope(b.schema)
    names = list(dict.fromkeys([*a.columns, *b.columns]))
    kinds = {n: V.common([sa.path(n).dtype, sb.path(n).dtype]) for n in names}
    pick = lambda df, s: df.select(*(V.to(s.path(n), kinds[n]).col.alias(n) for n in names))
    return pick(a, sa).unionByName(pick(b, sb))


@dataclass
class Collection:
    engine: Engine
    name: str

    @property
    def df(self) -> DataFrame:
        return self.engine.frame(self.name)

    # --- reads

    def find(self, filter: dict | None = None, *, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        steps: list[dict] = [{"$match": filter}] if filter else []
        steps += [{"$sort": sort}] if sort else []
        steps += [{"$skip": skip}] if skip > 0 else []
        steps += [{"$limit": limit}] if limit > 0 else []
        return self.aggregate(steps)

    def count(self, filter: dict | None = None) -> int:
        return self.find(filter).count()

    def aggregate(self, pipeline: list[dict]) -> DataFrame:
        return compile_pipeline(self.df, pipeline, self.engine, self.engine.keys.get(self.name))

    def stats(self) -> dict:
        row = self.df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).first()
        return {"ns": self.name, "count": row.n, "size": row.size, "nindexes": 1 + len(self.list_indexes())}

    # --- indexes

    def create_index(self, fields: list[str], *, unique: bool = False, name: str | None = None) -> str:
        """Only unique indexes have an effect; fields are top-level ones."""
        name = name or "_".join(f"{f}_1" for f in fields)
        if unique:
            self._check(self.df, {name: fields})
            self.engine.indexes.setdefault(self.name, {})[name] = list(fields)
        return name

    def list_indexes(self) -> dict[str, list[str]]:
        return dict(self.engine.indexes.get(self.name, {}))

    def drop_index(self, name: str) -> None:
        self.engine.indexes.get(self.name, {}).pop(name, None)

    def _keys(self, df: DataFrame, fields: list[str]) -> DataFrame | None:
        """(~~row, ~~k0, ...) of an index as text; arrays count by element, rows that lack a field do not count."""
        if any(f not in df.columns for f in fields):
            return None
        rows = df.withColumn("~~row", F.monotonically_increasing_id())
        kinds = {f.name: f.dataType for f in df.schema.fields}
        for k, f in enumerate(fields):
            col = F.col(f"`{f}`")
            rows = rows.withColumn(f"~~k{k}", F.explode(F.array_distinct(col)) if isinstance(kinds[f], T.ArrayType) else col)
        ks = [f"~~k{k}" for k in range(len(fields))]
        rows = rows.dropna(subset=ks)
        return rows.select("~~row", *(V.text(Value(F.col(k), rows.schema[k].dataType)).alias(k) for k in ks))

    def _check(self, df: DataFrame, indexes: dict[str, list[str]], held: DataFrame | None = None) -> None:
        """Raises where two rows of ``df`` share a key, or one shares it with a row of ``held``."""
        for name, fields in indexes.items():
            mine = self._keys(df, fields)
            if mine is None:
                continue
            ks = [f"~~k{k}" for k in range(len(fields))]
            twice = mine.groupBy(*ks).agg(F.count_distinct("~~row").alias("n")).where("n > 1")
            theirs = self._keys(held, fields) if held is not None else None
            if not twice.isEmpty() or (theirs is not None and not theirs.select(*ks).join(mine.select(*ks).distinct(), ks, "left_semi").isEmpty()):
                raise DuplicateKey(f"index {name} of {self.name}")

    # --- writes

    def _unique(self, df: DataFrame) -> dict[str, list[str]]:
        return {**self.list_indexes(), **({"_id_": ["_id"]} if "_id" in df.columns else {})}

    def _swap(self, df: DataFrame) -> None:
        """The collection becomes ``df``."""
        snapshot = stored(df, f"snapshot-{self.name.replace('.', '-')}")
        self._check(snapshot, self._unique(df))
        self._set(snapshot, 1)

    def _append(self, new: DataFrame) -> None:
        """Only the new rows are written and held against the keys that are there; every ``MOST_PARTS`` times all rows are written together."""
        if not self.engine.has(self.name):
            return self._swap(new)
        old, part = self.df, stored(new, f"part-{self.name.replace('.', '-')}")
        self._check(part, self._unique(part), old)
        parts = self.engine.parts.get(self.name, 1) + 1
        both = aligned(old, part)
        if parts > MOST_PARTS:
            both, parts = stored(both, f"snapshot-{self.name.replace('.', '-')}"), 1
        self._set(both, parts)

    def _set(self, df: DataFrame, parts: int) -> None:
        self.engine.tables[self.name] = df
        self.engine.parts[self.name] = parts
        self.engine.keys.setdefault(self.name, "_id" if "_id" in df.columns else None)

    def insert(self, docs: list[dict]) -> list:
        """Adds documents; one without _id gets one. New fields become columns."""
        docs = [d if "_id" in d else {"_id": uuid.uuid4().hex[:24], **d} for d in docs]
        if not docs:
            return []
        new = frame_of(self.engine.spark, docs)
        self._append(new)
        return [d["_id"] for d in docs]

    def insert_frame(self, df: DataFrame) -> None:
        """Adds the rows of a data frame, without passing the driver."""
        self._append(df)

    def _hits(self, filter: dict, first_only: bool) -> DataFrame:
        """All rows with ``~~hit``; of the first match only, by the collection's key."""
        df = self.df
        rows = df.withColumn("~~hit", F.coalesce(compile_filter(filter, Scope(df.schema)), F.lit(False)))
        if not first_only:
            return rows
        key = self.engine.keys.get(self.name)
        rows = stored(rows.withColumn("~~at", F.monotonically_increasing_id()), "hits")
        order = F.struct(F.col(f"`{key}`"), F.col("~~at")) if key else F.struct(F.col("~~at"))
        low = rows.where(F.col("~~hit")).agg(F.min(order).alias("m")).select(F.col("m.~~at").alias("~~first"))
        one = rows.crossJoin(F.broadcast(low))  # one row
        return one.withColumn("~~hit", F.coalesce(F.col("~~at") == F.col("~~first"), F.lit(False))).drop("~~at", "~~first")

    def update(self, filter: dict, update: dict, *, multi: bool = False, upsert: bool = False) -> UpdateResult:
        rows = stored(self._hits(filter, not multi), "update")
        matched = rows.where(F.col("~~hit")).count()
        if not matched:
            if not upsert:
                return UpdateResult(0, 0)
            return UpdateResult(0, 0, self.insert([U.upserted(filter, update)])[0])
        schema = T.StructType([f for f in rows.schema.fields if f.name != "~~hit"])
        new = U.applied(schema, update, F.col("~~hit"))
        scope = Scope(schema)
        changed = F.lit(False)
        for n, v in new.items():
            old = V.to(scope.path(n), v.dtype)
            changed = changed | ~v.col.eqNullSafe(old.col)
        modified = rows.where(F.col("~~hit") & changed).count()
        self._swap(rows.select(*(v.col.alias(n) for n, v in new.items())))
        return UpdateResult(matched, modified)

    def delete(self, filter: dict, *, limit: int = 0) -> int:
        rows = stored(self._hits(filter, limit == 1), "delete")
        n = rows.where(F.col("~~hit")).count()
        if n:
            self._swap(rows.where(~F.col("~~hit")).drop("~~hit"))
        return n
