"""Pipelines to plans: rewriting, order tracking and the run over stages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.errors import BadSpec, UnsupportedOperator
from docloom.functions import values as V
from docloom.operators import stages as S
from docloom.operators.stages import ORD, Frame

#: What makes the order of rows matter.
ORDERED = ('"$first"', '"$last"', '"$push"', '"$lookup"', '"$graphLookup"', '"$setWindowFields"', '"$bucketAuto"', '"$facet"', '"$sortByCount"')


def key_of(stage: dict) -> str:
    if not isinstance(stage, dict) or len(stage) != 1:
        raise BadSpec("a stage is a document with one key")
    return next(iter(stage))


def rewritten(pipeline: list[dict]) -> list[dict]:
    """Neighbouring limits meet in the least, skips in their sum; vector searches come first or after matches only."""
    out: list[dict] = []
    for step in pipeline:
        name = key_of(step)
        if name not in S.STAGES:
            raise UnsupportedOperator(f"stage {name}")
        if name == "$vectorSearch" and any(key_of(s) != "$match" for s in out):
            raise BadSpec("$vectorSearch comes first or after $match only")
        if out and name == key_of(out[-1]) == "$limit":
            out[-1] = {"$limit": min(S.counted(step[name]), S.counted(out[-1][name]))}
        elif out and name == key_of(out[-1]) == "$skip":
            out[-1] = {"$skip": S.counted(step[name]) + S.counted(out[-1][name])}
        else:
            out.append(step)
    return out


def needs_order(pipeline: list[dict]) -> bool:
    said = json.dumps(pipeline, default=str)
    return any(w in said for w in ORDERED)


def run_stages(frame: Frame, pipeline: list[dict]) -> Frame:
    steps = rewritten(pipeline)
    k = 0
    while k < len(steps):
        name, spec = key_of(steps[k]), steps[k][key_of(steps[k])]
        after = steps[k + 1] if k + 1 < len(steps) else {}
        unwind = after.get("$unwind")
        unwind = {"path": unwind} if isinstance(unwind, str) else unwind
        if name == "$lookup" and unwind and unwind["path"] == f"${spec['as']}" and S.plain_lookup(frame, spec):
            frame = S.joined_lookup(frame, spec, bool(unwind.get("preserveNullAndEmptyArrays")))
            k += 2
            continue
        frame = S.STAGES[name](frame, spec)
        k += 1
    return frame


def compile_pipeline(df: DataFrame, pipeline: list[dict], catalog=None, key: str | list[str] | None = None) -> DataFrame:
    """The pipeline over ``df`` as one lazy plan. ``key`` names the columns that order the rows where order matters; without one it is the order of the scan."""
    hidden = [c for c in df.columns if c.startswith(V.HIDDEN)]
    if hidden:
        raise BadSpec(f"names that start with {V.HIDDEN} are reserved: {hidden}")
    frame = Frame(df, catalog)
    if needs_order(pipeline):
        keys = [key] if isinstance(key, str) else key
        order = F.struct(*(S.q(k) for k in keys)) if keys else F.struct(F.monotonically_increasing_id().alias("i"))
        frame = frame.with_df(df.withColumn(ORD, order))
    out = run_stages(frame, pipeline)
    return out.df.select(*(S.q(c) for c in out.columns))
