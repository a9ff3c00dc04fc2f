"""docloom: document filters, pipelines and updates compiled to Spark DataFrame plans."""

from docloom.errors import BadSpec, UnsupportedOperator
from docloom.plans.compiler import compile_pipeline
from docloom.sources.collection import Collection, DuplicateKey, Engine

__all__ = ["BadSpec", "Collection", "DuplicateKey", "Engine", "UnsupportedOperator", "compile_pipeline"]
