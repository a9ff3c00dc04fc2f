"""Pipelines over streams: the stages that keep no state, on a streaming data frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docloom.errors import UnsupportedOperator
from docloom.plans.compiler import compile_pipeline, key_of

#: Stages whose rows depend on one row each.
STATELESS = {"$match", "$project", "$addFields", "$set", "$unset", "$unwind", "$replaceRoot", "$replaceWith"}


def compile_stream(df: DataFrame, pipeline: list[dict]) -> DataFrame:
    """The pipeline over ``readStream`` rows; stages that need other rows raise."""
    for step in pipeline:
        if key_of(step) not in STATELESS:
            raise UnsupportedOperator(f"{key_of(step)} on a stream")
    return compile_pipeline(df, pipeline)
