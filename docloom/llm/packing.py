"""Conflict-constrained best-fit packing of documents into fixed-size bins."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE_CLASS, ceil_div, n_words_of, text_of

#: Bins of one shard are numbered below this.
BINS = 1 << 24
SCHEMA = "doc_id long, piece long, n_pieces long, piece_tokens long, bin_id long, bin_offset long, bin_tokens long"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit in decreasing order of size.

    Open bins lie in one list ordered by residual. A bin carries a bitmap of the
    sources and one of the duplicate clusters it holds; an item may not enter a
    bin that holds its source or its cluster. The search starts at the smallest
    residual that takes the item and goes on to the next larger one until a
    compatible bin is found, so that bin is the tightest compatible one; ties go
    to the older bin. Returns each item's bin and offset, and each bin's tokens.
    """
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    repeated = [c for c, n in Counter(clusters).items() if n > 1]
    cluster_bit = {c: 1 << k for k, c in enumerate(repeated)}
    free: list[int] = []  # residual * BINS + bin
    held_sources: list[int] = []
    held_clusters: list[int] = []
    used: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, s, c = sizes[i], source_bit[sources[i]], cluster_bit.get(clusters[i], 0)
        at = bisect_left(free, size * BINS)
        while at < len(free):
            b = free[at] % BINS
            if not (held_sources[b] & s or held_clusters[b] & c):
                break
            at += 1
        if at < len(free):
            del free[at]
        else:
            b = len(used)
            used.append(0)
            held_sources.append(0)
            held_clusters.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        held_sources[b] |= s
        held_clusters[b] |= c
        if used[b] < capacity:
            insort(free, (capacity - used[b]) * BINS + b)
    return bins, offsets, used


def cluster_of(text: Column) -> Column:
    """Duplicate cluster of a text: digest of its words in lower case."""
    return F.md5(F.lower(F.regexp_replace(text, SPACE_CLASS + "+", " ")))


def pack(docs: DataFrame, capacity: int = 2048, *, tokens: Column | None = None, source: str = "source", cluster: Column | None = None, shard_rows: int = 2048) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text, source) into bins of ``capacity`` tokens.

    Tokens are words unless ``tokens`` says otherwise; clusters are texts equal
    but for case and white space unless ``cluster`` does. Documents longer than a
    bin are cut into pieces of ``capacity`` and a rest. Rows are dealt evenly, not
    by key, and each run of ``shard_rows`` rows is packed on its own, so no
    source, cluster or repeated doc_id gathers in one task.

    One row per piece. Null or empty texts: one piece of 0 tokens with null
    bin_id. A null source is a source of its own; null doc_ids and repeated rows
    are packed like others. Ties in size keep the order (doc_id, cluster, piece).
    Other columns of ``docs`` are not read.
    """
    n = tokens if tokens is not None else n_words_of(text_of("text"))
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n"), F.col(source).cast("string").alias("source"), (cluster if cluster is not None else cluster_of(text_of("text"))).cast("string").alias("cluster"))
    parts = max(1, ceil_div(docs.count(), 4 * shard_rows))

    def shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        waiting: list[pd.DataFrame] = []
        rows = shard = 0
        for frame in frames:
            while len(frame):
                head, frame = frame.iloc[: shard_rows - rows], frame.iloc[shard_rows - rows :]
                waiting.append(head)
                rows += len(head)
                if rows == shard_rows:
                    yield packed(pd.concat(waiting), part, shard)
                    waiting, rows, shard = [], 0, shard + 1
        if rows:
            yield packed(pd.concat(waiting), part, shard)

    def packed(frame: pd.DataFrame, part: int, shard: int) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "cluster"], kind="stable", na_position="first")
        out, sizes, sources, clusters = [], [], [], []
        empty = []
        for doc_id, total, source_, cluster_ in zip(frame["doc_id"].astype("Int64"), frame["n"], frame["source"], frame["cluster"], strict=True):
            if not total > 0:
                empty.append((doc_id, 0, 1, 0, pd.NA, pd.NA, pd.NA))
                continue
            pieces = ceil_div(int(total), capacity)
            for k in range(pieces):
                size = min(capacity, int(total) - k * capacity)
                out.append((doc_id, k, pieces, size))
                sizes.append(size)
                sources.append(source_)
                clusters.append(cluster_)
        bins, offsets, used = best_fit(sizes, sources, clusters, capacity)
        first = (part * (1 << 16) + shard) * BINS
        rows = [(*row, first + b, at, used[b]) for row, b, at in zip(out, bins, offsets, strict=True)]
        return pd.DataFrame(rows + empty, columns=["doc_id", "piece", "n_pieces", "piece_tokens", "bin_id", "bin_offset", "bin_tokens"]).astype("Int64")

    return items.repartition(parts).mapInPandas(shards, SCHEMA)
