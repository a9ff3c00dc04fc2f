"""Exact top-k inner-product search with a ball tree per shard."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ceil_div, new_path, opened, put_file, stored

#: Whole numbers below these, and sums of products whose lengths multiply to less, are exact in float32, in float64.
SINGLE, EXACT = float(1 << 24), float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Rows of a leaf: with a block of queries, a product that stays in a core's cache.
LEAF = 512
#: Shards and blocks of queries that a task reads together, and tasks of a round at most.
SHARDS_A_TASK, BLOCKS_A_TASK, TASKS = 16, 32, 4096


def build(vectors: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Ball tree: order of rows, nodes (start, stop, left, right), centres and radii.

    A node is halved at the median along the line between two far points.
    """
    order = np.arange(len(vectors))
    nodes: list[tuple[int, int, int, int]] = []
    centres, radii = [], []

    def grow(start: int, stop: int) -> int:
        own = vectors[order[start:stop]]
        centre = own.mean(axis=0)
        gaps = np.sqrt(((own - centre) ** 2).sum(axis=1))
        at = len(nodes)
        nodes.append((start, stop, -1, -1))
        centres.append(centre)
        radii.append(gaps.max())
        if stop - start > leaf and radii[at] > 0:
            far = own[gaps.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            middle = (stop - start) // 2
            split = np.argpartition(own @ (other - far), middle)
            order[start:stop] = order[start:stop][split]
            left = grow(start, start + middle)
            nodes[at] = (start, stop, left, grow(start + middle, stop))
        return at

    grow(0, len(vectors))
    return order, nodes, np.array(centres), np.array(radii)


class Tree:
    """A shard's vectors under a ball tree, as ``packed`` has written them."""

    def __init__(self, data: dict[str, np.ndarray]):
        self.ids, self.nodes, self.centres, self.radii = data["ids"], data["nodes"].tolist(), data["centres"], data["radii"]
        self.vectors = data["vectors"]
        self.single = self.vectors.astype(np.float32)
        self.norms = lengths(self.vectors)
        self.longest = float(self.norms.max())

    def search(self, block: Block) -> None:
        """Better rows of this shard into the tops of ``block``.

        Nodes are taken by the upper bounds of their inner products, q . centre
        + |q| radius, for all queries of the block at once; a node whose bounds
        are all under the kth scores is left out with all below it. Equal bounds
        are still looked into, for ties go to smaller ids.
        """
        slack = 1e-9 * (1 + block.norms * self.longest)
        bounds = self.centres @ block.vectors.T + self.radii[:, None] * block.norms + slack
        promise = bounds.sum(axis=1)
        stack = [0]
        while stack:
            at = stack.pop()
            active = bounds[at] >= block.kth
            n = int(np.count_nonzero(active))
            if not n:
                continue
            start, stop, left, right = self.nodes[at]
            if left >= 0:
                stack += [right, left] if promise[left] >= promise[right] else [left, right]
            else:
                self.scan(block, start, stop, None if 2 * n > len(active) else np.flatnonzero(active))

    def scan(self, block: Block, start: int, stop: int, some: np.ndarray | None) -> None:
        """All products of a leaf's rows with the block's queries, or with ``some`` of them."""
        rows, size = stop - start, block.longest * self.longest
        if size < SINGLE:
            own, asked = self.single[start:stop], block.single
        else:
            own, asked = self.vectors[start:stop].astype(np.float64), block.vectors
        scores = block.product(own, asked if some is None else asked[some])
        floor = block.kth if some is None else block.kth[some]
        error = None
        if size >= EXACT:  # beyond float64: what may enter is told by the error's bound, then reckoned in whole numbers
            norms = block.norms if some is None else block.norms[some]
            error = self.norms[start:stop, None] * norms * ((len(own[0]) + 2) * 2.0**-51)
        if not block.full and rows > block.k:
            free = np.flatnonzero(floor == -np.inf)
            low = scores[:, free] if error is None else scores[:, free] - error[:, free]
            floor = floor.copy()
            floor[free] = np.partition(low, rows - block.k - 1, axis=0)[rows - block.k - 1]  # one more than k, for a query's own row
        if error is not None:
            scores = scores + error
        floor = floor.astype(scores.dtype)
        hit = np.flatnonzero(scores.max(axis=0) >= floor)
        if not len(hit):
            return
        at, to = np.nonzero(scores[:, hit] >= floor[hit])
        to = hit[to]
        queries = to if some is None else some[to]
        if error is None:
            found = scores[at, to].astype(np.int64)
        else:
            found = np.array([whole_product(self.vectors[start + i], block.vectors[q]) for i, q in zip(at, queries, strict=True)], dtype=np.int64)
        block.offer(queries, found, self.ids[start + at])


class Block:
    """Queries that are asked together, and the k best (score, vec_id) of each so far, best first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.ids, self.k, self.vectors, self.single = ids, k, vectors.astype(np.float64), vectors.astype(np.float32)
        self.norms = lengths(vectors)
        self.longest = float(self.norms.max())
        self.scores, self.found, self.new = np.full((len(ids), k), LEAST), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), bool)
        self.sizes = np.zeros(len(ids), np.int64)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.buffer = np.empty(LEAF * len(ids), np.float32)
        self.n_waiting = 0
        self.bound()
        if known is not None:
            self.merge(*known, np.zeros(len(known[0]), bool))

    def product(self, own: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """own @ asked.T, in float32 without new memory."""
        n = len(own) * len(asked)
        if own.dtype != np.float32 or n > len(self.buffer):
            return own @ asked.T
        return np.matmul(own, asked.T, out=self.buffer[:n].reshape(len(own), len(asked)))

    def bound(self) -> None:
        self.kth = np.where(self.sizes == self.k, self.scores[:, -1].astype(np.float64), -np.inf)
        self.full = bool((self.sizes == self.k).all())

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows that may enter; merged at once while places are free, else when many wait."""
        score, vec_id = self.scores[queries, -1], self.found[queries, -1]
        good = (ids != self.ids[queries]) & ((self.sizes[queries] < self.k) | (scores > score) | ((scores == score) & (ids < vec_id)))
        if not good.any():
            return
        self.waiting.append((queries[good], scores[good], ids[good]))
        self.n_waiting += len(self.waiting[-1][0])
        if not self.full or self.n_waiting >= 4 * len(self.ids):
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            queries, scores, ids = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.waiting, self.n_waiting = [], 0
            self.merge(queries, scores, ids, np.ones(len(queries), bool))

    def merge(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, new: np.ndarray) -> None:
        held = np.arange(self.k) < self.sizes[:, None]
        queries, scores = np.concatenate([np.nonzero(held)[0], queries]), np.concatenate([self.scores[held], scores])
        ids, new = np.concatenate([self.found[held], ids]), np.concatenate([self.new[held], new])
        order = np.lexsort((ids, ~scores, queries))  # ~: falling, without overflow
        queries = queries[order]
        rank = np.arange(len(queries)) - np.searchsorted(queries, queries)
        order, queries, rank = order[rank < self.k], queries[rank < self.k], rank[rank < self.k]
        self.scores[queries, rank], self.found[queries, rank], self.new[queries, rank] = scores[order], ids[order], new[order]
        self.sizes = np.bincount(queries, minlength=len(self.ids))
        self.bound()

    def tops(self, fresh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, score, vec_id) of the best; ``fresh``: only of those not known at the start."""
        self.settle()
        take = np.arange(self.k) < self.sizes[:, None]
        if fresh:
            take &= self.new
        return np.nonzero(take)[0], self.scores[take], self.found[take]


def lengths(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return np.sqrt((wide * wide).sum(axis=1))


def whole_product(a: np.ndarray, b: np.ndarray) -> int:
    """Inner product in whole numbers of any size, held within a long."""
    return max(LEAST, min(MOST, sum(int(x) * int(y) for x, y in zip(a, b, strict=True))))


def saved(target: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Arrays as a file of the shared folder; its path."""
    whole = io.BytesIO()
    np.savez(whole, **arrays)
    return put_file(target, f"{name}-{TaskContext.get().taskAttemptId()}.npz", lambda out: out.write(whole.getvalue()))


def loaded(uri: str) -> dict[str, np.ndarray]:
    system, path = opened(uri)
    with system.open_input_file(path) as stream:
        return dict(np.load(io.BytesIO(stream.read())))


def narrow(vectors: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them."""
    most = np.abs(vectors).max()
    return vectors.astype(np.int16 if most < 1 << 15 else np.float32 if most < SINGLE else np.float64)


def rows_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids, rising, and vectors; of rows whose vec_id repeats the one with the least vector."""
    ids, vectors = frame["vec_id"].to_numpy(np.int64), np.stack(list(frame["embedding"])).astype(np.float64)
    if frame["vec_id"].duplicated().any():
        order = np.lexsort([*vectors.T[::-1], ids])
        order = order[np.unique(ids[order], return_index=True)[1]]
    else:
        order = np.argsort(ids)
    return ids[order], vectors[order]


def search(vectors: DataFrame, queries: DataFrame, k: int, *, shard_rows: int = 4096, block_rows: int = 256) -> DataFrame:
    """The k highest integer inner products of each query among ``vectors``.

    Both frames hold vec_id and embedding (array of whole doubles). Vectors are
    dealt by hash to shards of about ``shard_rows`` rows, each under a ball tree
    that is built once and kept in a file of the shared folder; queries lie there
    in parts of ``BLOCKS_A_TASK`` blocks of ``block_rows``. A task reads a part of
    queries and, one after the other, ``SHARDS_A_TASK`` shards, so only paths and
    what is found go through Spark. First all queries meet a 64th of the shards,
    then an eighth, then the rest, and take the kth scores found so far along,
    which prune from the start. Shards and parts bound what a task holds; every
    query meets every shard, whose root at least is held against its kth score.

    Rows whose vec_id repeats count once, the least vector first. Of a shard's
    equal vectors, whose scores are equal for any query, the k + 1 smallest ids
    stay: no query can return others. Queries meet only vectors of their own
    number of components. Fewer than k rows: all of them.
    """
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, ceil_div(n, shard_rows)), max(1, ceil_div(m, block_rows))
    chunks, parts = ceil_div(shards, SHARDS_A_TASK), ceil_div(blocks, BLOCKS_A_TASK)
    target = new_path(vectors.sparkSession, "topk")
    part = lambda df, parts, name: df.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias(name))

    def packed(keys, frame: pd.DataFrame) -> pd.DataFrame:
        ids, rows = rows_of(frame)
        alike = pd.Series([row.tobytes() for row in rows])
        few = alike.groupby(alike).cumcount().to_numpy() <= k
        ids, rows = ids[few], rows[few]
        order, nodes, centres, radii = build(rows, LEAF)
        arrays = {"ids": ids[order], "vectors": narrow(rows[order]), "nodes": np.array(nodes, np.int64), "centres": centres, "radii": radii}
        return pd.DataFrame({"dim": [int(keys[0])], "shard": [int(keys[1])], "path": [saved(target, f"shard-{keys[0]}-{keys[1]}", arrays)]})

    def asked(keys, frame: pd.DataFrame) -> pd.DataFrame:
        ids, rows = rows_of(frame)
        return pd.DataFrame({"dim": [int(keys[0])], "part": [int(keys[1])], "q_path": [saved(target, f"queries-{keys[0]}-{keys[1]}", {"ids": ids, "vectors": narrow(rows)})]})

    trees = stored(part(vectors, shards, "shard").groupBy("dim", "shard").applyInPandas(packed, "dim int, shard int, path string"), "topk-shards")
    grouped = trees.groupBy("dim", F.floor(F.col("shard") / SHARDS_A_TASK).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    known = stored(part(queries, parts, "part").groupBy("dim", "part").applyInPandas(asked, "dim int, part int, q_path string"), "topk-queries").withColumn("best", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell in frame.itertuples(index=False):
                data, best = loaded(cell.q_path), loaded(cell.best) if cell.best else None
                waiting = []
                for at in range(0, len(data["ids"]), block_rows):
                    own = None
                    if best is not None:
                        mine = (best["place"] >= at) & (best["place"] < at + block_rows)
                        own = (best["place"][mine] - at, best["score"][mine], best["vec_id"][mine])
                    waiting.append(Block(data["ids"][at : at + block_rows], data["vectors"][at : at + block_rows], k, own))
                for path in cell.paths:
                    tree = Tree(loaded(path))
                    for block in waiting:
                        tree.search(block)
                found = [block.tops(fresh=True) for block in waiting]
                place = np.concatenate([f[0] + i * block_rows for i, f in enumerate(found)])
                yield pd.DataFrame({"dim": [cell.dim], "part": [cell.part], "q_path": [cell.q_path], "best": [cell.best], "place": [place.tobytes()], "score": [np.concatenate([f[1] for f in found]).tobytes()], "vec_id": [np.concatenate([f[2] for f in found]).tobytes()]})

    def joined(frame: pd.DataFrame) -> tuple[np.ndarray, Block]:
        """A part's queries with the best of all its cells and of the rounds before."""
        data, best = loaded(frame["q_path"].iloc[0]), frame["best"].iloc[0]
        block = Block(data["ids"], data["vectors"], k, tuple(loaded(best)[c] for c in ("place", "score", "vec_id")) if best else None)
        for row in frame.itertuples(index=False):
            if row.place:
                block.merge(*(np.frombuffer(x, np.int64) for x in (row.place, row.score, row.vec_id)), np.ones(len(row.place) // 8, bool))
        return data["ids"], block

    def kept(keys, frame: pd.DataFrame) -> pd.DataFrame:
        place, score, vec_id = joined(frame)[1].tops(fresh=False)
        path = saved(target, f"best-{keys[0]}-{keys[1]}", {"place": place, "score": score, "vec_id": vec_id})
        return pd.DataFrame({"dim": [int(keys[0])], "part": [int(keys[1])], "q_path": [frame["q_path"].iloc[0]], "best": [path]})

    def told(keys, frame: pd.DataFrame) -> pd.DataFrame:
        ids, block = joined(frame)
        place, score, vec_id = block.tops(fresh=False)
        return pd.DataFrame({"query_id": ids[place], "vec_id": vec_id, "score": score})

    ends = sorted({ceil_div(chunks, 64), ceil_div(chunks, 8), chunks}) if chunks >= 8 else [chunks]
    for start, end in zip([0, *ends], ends):
        cells = grouped.where((F.col("chunk") >= start) & (F.col("chunk") < end)).join(known, "dim").repartition(min((end - start) * parts, TASKS))
        shape = "dim int, part int, q_path string, best string, place binary, score binary, vec_id binary"
        met = stored(cells.select("dim", "part", "q_path", "best", "paths").mapInPandas(run, shape), "topk-found")
        none = F.lit(b"")
        found = met.unionByName(known.select("*", none.alias("place"), none.alias("score"), none.alias("vec_id"))).groupBy("dim", "part")  # also parts that met no shard in this round
        if end < chunks:
            known = stored(found.applyInPandas(kept, "dim int, part int, q_path string, best string"), "topk-best")
    top = F.slice(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id"))), 1, k)
    merged = found.applyInPandas(told, "query_id long, vec_id long, score long").groupBy("query_id").agg(top.alias("top"))
    return merged.select("query_id", F.posexplode("top").alias("i", "t")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.bitwise_not("t.s").alias("score"))


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id and floor(256 x) of each component.

    Vectors that are null or empty, hold null or non-finite components, or have a
    null vec_id take no part. A component whose 256-fold leaves the range of a
    long is held at its end. Rows that repeat stay (``search`` counts a vec_id
    once). An empty table gives an empty result. Other columns, whatever their
    names, are not read.
    """
    x = F.col("embedding").cast("array<double>")
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 256).cast("double")).alias("embedding"))
