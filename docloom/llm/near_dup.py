"""N-gram Jaccard join with Bayesian pruning of candidates, and the classes it links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import forget, free_names, stored, text_of

#: Signature: BANDS x ROWS MinHash values, 16 bits of each. At a similarity of 0.8 two texts share no band in 6 of 10 million cases.
BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
#: MinHash values compared at a time.
STEP = 20
SKETCH = "doc_id long, text_key long, fp binary, n int, sig binary"
#: Bits of the filter that rows pass before their texts are dealt: at most BITS / 64 rows of two longs (4 MB) go to every task. Beyond some BITS wanted ids it lets all pass, and only the saving is gone.
BITS = 1 << 24


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles of each text of an Arrow array, ascending, and the bounds between texts.

    Words are runs without ASCII white space; a text of fewer than ``width``
    words is one shingle, an empty one none.
    """
    import pyarrow.compute as pc
    import xxhash

    lists = pc.ascii_split_whitespace(texts)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    # the splitter gives empty words at the ends of a text
    known = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in words), np.uint64, len(words))
    full = np.fromiter((bool(w) for w in words), bool, len(words))
    which = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    if len(which):
        keep = full[which]
        which, doc = which[keep], doc[keep]
    hashes = known[which] if len(which) else np.zeros(0, np.uint64)
    size = np.bincount(doc, minlength=len(size)).astype(np.int64)
    ends = np.cumsum(size)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(hashes), np.uint64)
        reach = np.minimum(np.repeat(size, size), width)
        left = np.repeat(ends, size) - np.arange(len(hashes))
        for k in range(width):
            use = reach > k
            moved = np.zeros(len(hashes), np.uint64)
            moved[: len(hashes) - k] = hashes[k:] if k else hashes
            rolled = np.where(use & (left > k), mix(rolled + moved + np.uint64(k + 1)), rolled)
        real = left >= reach
    doc, rolled = doc[real], rolled[real]
    order = np.lexsort((rolled, doc))
    doc, rolled = doc[order], rolled[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])])
        doc, rolled = doc[new], rolled[new]
    return rolled, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(size)))]).astype(np.int64)


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of each non-empty set, 16 low bits of each."""
    rng = np.random.default_rng(20240229)
    flips = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
    turns = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(bounds) - 1, HASHES), np.uint16)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    at = 0
    while at < len(some):  # slices that stay in cache
        to = max(at + 1, int(np.searchsorted(bounds[some], bounds[some[at]] + (1 << 15), side="right")) - 1)
        part = some[at:to]
        own, starts = sets[bounds[part[0]] : bounds[part[-1] + 1]], bounds[part] - bounds[part[0]]
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                out[part, k] = np.minimum.reduceat(((own ^ flips[k]) * turns[k]) >> np.uint64(24), starts).astype(np.uint16)
        at = to
    return out


def pieces(batch, most: int = 1 << 20):
    """An Arrow batch in slices of about ``most`` bytes of text (column 1); arrays over the words of a slice take some 16 times its bytes."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(size // most)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of the shingle set, its size and signature."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                sets, bounds = shingle_sets(part.column(1))
                sig = signatures(sets, bounds)
                prints = [hashlib.md5(sets[a:b].tobytes()).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(prints, pa.binary()), pa.array(np.diff(bounds).astype(np.int32)), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "text_key", "fp", "n", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), F.xxhash64("text").alias("text_key")).mapInArrow(run, SKETCH)


def maybe_wanted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those rows of ``rows`` (doc_id, text) whose id may be in ``ids`` (want): all that are, and of others the share of bits set."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    word, bit = F.floor(F.col("h") / 64).cast("long").alias("at"), (F.col("h") % 64).cast("int")
    marks = ids.select(place("want").alias("h")).groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    told = F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    # BITS / 64 rows at most
    return rows.withColumn("h", place("doc_id")).select("*", word).join(F.broadcast(marks), "at").where(told).select("doc_id", "text")


def full_sets(docs: DataFrame) -> DataFrame:
    """Fingerprint and shingle set (array of long) of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                sets, bounds = shingle_sets(part.column(1))
                prints = [hashlib.md5(sets[a:b].tobytes()).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), lists], names=["fp", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "fp binary, shingles array<long>")


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, the posterior probability that the similarity reaches the threshold is under the tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m+1, n-m+1),
    whose mass above t equals the chance of at most m successes in n+1 trials of t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, rules: list[tuple[int, int]]) -> np.ndarray:
    """Which of the row pairs of two signature tables no rule drops, compared a step at a time."""
    left, met, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in rules:
        met = met + (a[left, done:n] == b[left, done:n]).sum(axis=1)
        keep = met >= least
        left, met, done = left[keep], met[keep], n
    return left


def common_counts(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Size of every intersection between two lists of sets: products of 0/1 tables over the shingles that occur on both sides."""
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    shared = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(sets_a), len(sets_b)), np.float32)
    if not len(shared):
        return out
    row_a, row_b = np.repeat(np.arange(len(sets_a)), [len(x) for x in sets_a]), np.repeat(np.arange(len(sets_b)), [len(x) for x in sets_b])

    def at(flat, row):
        place = np.searchsorted(shared, flat)
        hit = (place < len(shared)) & (shared[np.minimum(place, len(shared) - 1)] == flat)
        return row[hit], place[hit]

    (ra, pa), (rb, pb) = at(flat_a, row_a), at(flat_b, row_b)
    for k in range(0, len(shared), 4096):
        ta, tb = np.zeros((len(sets_a), 4096), np.float32), np.zeros((len(sets_b), 4096), np.float32)
        ua, ub = (pa >= k) & (pa < k + 4096), (pb >= k) & (pb < k + 4096)
        ta[ra[ua], pa[ua] - k], tb[rb[ub], pb[ub] - k] = 1, 1
        out += ta @ tb.T
    return out


def block_links(frame: pd.DataFrame, threshold: float, rules: list[tuple[int, int]]) -> pd.DataFrame:
    """Links within one chunk, or between two chunks, of a crowded cluster: per text the copies it is linked to, and one edge to the first text of its local component."""
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    a = frame[frame["chunk"] == i]
    b = a if i == j else frame[frame["chunk"] == j]
    empty = pd.DataFrame({"fp": [], "to": [], "links": []})
    if not len(a) or not len(b):
        return empty
    sig = lambda x: np.stack([np.frombuffer(s, np.uint16) for s in x["sig"]])
    sa, sb = sig(a), sig(b)
    met, alive, done = np.zeros((len(a), len(b)), np.int16), np.ones((len(a), len(b)), bool), 0
    for n, least in rules:
        if alive.mean() < 0.05:
            x, y = np.nonzero(alive)
            for m, need in [(m, need) for m, need in rules if m > done]:
                met[x, y] += (sa[x, done:m] == sb[y, done:m]).sum(axis=1).astype(np.int16)
                alive[x, y] &= met[x, y] >= need
                x, y, done = *np.nonzero(alive), m
            break
        for k in range(done, n):
            met += sa[:, k, None] == sb[None, :, k]
        alive &= met >= least
        done = n
    if i == j:
        np.fill_diagonal(alive, False)
    if not alive.any():
        return empty
    ia, ib = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    lists_a, lists_b = a["shingles"].to_numpy(), b["shingles"].to_numpy()
    sets_a, sets_b = [np.asarray(lists_a[k], np.int64) for k in ia], [np.asarray(lists_b[k], np.int64) for k in ib]
    both = common_counts(sets_a, sets_b)
    na, nb = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    linked = (both >= threshold * (na[:, None] + nb[None, :] - both) - 1e-6) & alive[np.ix_(ia, ib)]
    ca, cb = a["copies"].to_numpy()[ia], b["copies"].to_numpy()[ib]
    fa, fb = a["fp"].to_numpy()[ia], b["fp"].to_numpy()[ib]
    names = list(fa) if i == j else [*fa, *fb]
    links = linked @ cb if i == j else np.concatenate([linked @ cb, linked.T @ ca])
    # local components, by spreading the least row number
    label = np.arange(len(names))
    x, y = np.nonzero(linked)
    if i != j:
        y = y + len(fa)
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    touched = links > 0
    return pd.DataFrame({"fp": [n for n, t in zip(names, touched, strict=True) if t], "to": [names[k] for k, t in zip(label, touched, strict=True) if t], "links": links[touched].astype(np.int64)})


def with_least(edges: DataFrame, n_edges: int, and_self: bool) -> DataFrame:
    """(a, b, m) for each edge (a, b): m is the least b of all edges of a, or a itself if that counts and is less.

    Nodes of many edges, the roots of large classes, would each gather in one
    task. There are at most 2,000 nodes of more than ``n_edges`` / 1,000 edges
    (``edges`` holds each of the ``n_edges`` twice at most), so theirs are
    broadcast; the edges of all others are joined by shuffle.
    """
    most = max(256, n_edges // 1000)
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("held"))
    least = least.select(F.col("a").alias("u"), (F.least("a", "m") if and_self else F.col("m")).alias("m"), "held")
    hot = least.where(F.col("held") > most).select(F.col("u").alias("hot_u"), F.col("m").alias("hot_m"))
    told = edges.join(F.broadcast(hot), F.col("a") == F.col("hot_u"), "left")
    rest = told.where("hot_u is null").select("a", "b").join(least.where(F.col("held") <= most), F.col("a") == F.col("u")).select("a", "b", "m")
    return rest.unionByName(told.where("hot_u is not null").select("a", "b", F.col("hot_m").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every node of ``edges`` (a, b): root is the least fp of its component.

    Alternating large-star and small-star rounds; only edges move, every round is
    written to the shared folder, and the loop ends when a round changes nothing.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, seen[0], True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = with_least(large, seen[0], False)
        # of each node: the edges of its larger neighbours, then of itself, to its least one
        nxt = stored(small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now, old = nxt, now
        forget(old)
        was, seen = seen, mark(now)
        if was == seen:
            break
    return now.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())


def classes(docs: DataFrame, *, threshold: float = 0.8, tolerance: float = 1e-6, crowd: int = 16, chunk: int = 1024, chunk_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, class_id, n_links and copy_id for each row of ``docs`` (doc_id, text).

    Two rows are linked if the Jaccard similarity of their sets of five-word
    shingles is at least ``threshold``; class_id is the least doc_id of all rows
    that links join, n_links the rows a row is linked to, copy_id the least
    doc_id with the same set. Equal sets go on as one text with a count, so
    copies are never paired. Texts that share a band of MinHash values are
    candidates. Bands met by up to ``crowd`` texts give pairs. Texts of larger
    bands are gathered to clusters first, and a cluster is compared in blocks of
    two chunks of about ``chunk`` texts, or ``chunk_shingles`` shingles where that
    is less, which return a row a text, not a pair: no candidate is dropped and no
    task holds more than two chunks. Each text of a cluster goes to as many blocks
    as the cluster has chunks. Either way
    MinHash values are compared ``STEP`` at a time, pairs fall out when the
    posterior probability of reaching the threshold is under ``tolerance``, and
    the rest are verified on the full sets.

    Null and empty texts are linked to nothing and are classes of their own. Null
    doc_ids take part; a class of them alone has a null class_id. Unlinked texts
    under one doc_id share their class_id; class_key tells such classes apart:
    the least fingerprint of a class, id and text of an empty text. Repeated rows
    are copies. A pair just at the threshold is linked. Texts are read whole,
    however long. An empty table gives an empty result. Other columns, whatever
    their names, are not read.
    """
    rules = least_matches(threshold, tolerance)
    every = stored(sketches(docs), "near-sketches")
    reps = stored(every.where("n > 0").groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-texts")
    width = 2 * ROWS
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * width + 1, F.lit(width)))))
    banded = reps.select("fp", band.alias("bucket"))
    # a count of longs is hashed; the least text would have all bands sorted, and only crowded ones need it
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    multi = stored(banded.join(sizes, "bucket"), "near-bands")

    crowded = multi.where(F.col("met") > crowd).select("bucket", "fp")
    heads = crowded.groupBy("bucket").agg(F.min("fp").alias("head"))
    clusters = stored(components(crowded.join(heads, "bucket").select(F.col("fp").alias("a"), F.col("head").alias("b"))), "near-clusters")
    few = multi.where(F.col("met") <= crowd).select("bucket", "fp")
    pairs = few.join(few.withColumnRenamed("fp", "fp2"), "bucket").where("fp < fp2").select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()
    in_a, in_b = clusters.select(F.col("fp").alias("a"), F.col("root").alias("ra")), clusters.select(F.col("fp").alias("b"), F.col("root").alias("rb"))
    pairs = pairs.join(in_a, "a", "left").join(in_b, "b", "left").where("ra is null or rb is null or ra <> rb").select("a", "b")
    side = lambda x: reps.select(F.col("fp").alias(x), F.col("sig").alias(f"sig_{x}"))

    def prune(batches):
        for batch in batches:
            if batch.num_rows:
                table = lambda k: np.stack([np.frombuffer(x, np.uint16) for x in batch.column(k).to_pylist()])
                keep = survivors(table(2), table(3), rules)
                import pyarrow as pa

                yield batch.select(["a", "b"]).take(pa.array(keep))

    likely = stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(prune, "a binary, b binary"), "near-likely")

    needed = likely.select(F.col("a").alias("fp")).unionByName(likely.select(F.col("b").alias("fp"))).unionByName(clusters.select("fp")).distinct()
    ids = stored(needed.join(reps, "fp").select(F.col("least").alias("want")).distinct(), "near-wanted")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    # most texts are not wanted: the filter keeps them out of the shuffle; Spark would move a semi join below it, and ids are distinct
    texts = maybe_wanted(plain, ids).join(ids, F.col("doc_id").eqNullSafe(F.col("want"))).select("doc_id", "text")
    sets = stored(full_sets(texts).dropDuplicates(["fp"]).join(reps.select("fp", "copies", "sig"), "fp"), "near-sets")
    whole = lambda x: sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"set_{x}"), F.col("copies").alias(f"copies_{x}"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("double")
    similar = both >= F.lit(threshold) * (F.size("set_a") + F.size("set_b") - both) - F.lit(1e-9)
    links = stored(likely.join(whole("a"), "a").join(whole("b"), "b").where(similar).select("a", "b", "copies_a", "copies_b"), "near-links")

    within = clusters.join(reps.select("fp", "n"), "fp")
    held = within.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
    parts = F.ceil(F.greatest(F.col("m") / F.lit(float(chunk)), F.col("size") / F.lit(float(chunk_shingles)))).cast("int")
    members = held.select("root", parts.alias("parts")).join(clusters, "root").join(sets, "fp")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("root", "fp", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "sig", "shingles", "copies")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return block_links(frame, threshold, rules)

    inside = stored(members.groupBy("root", "i", "j").applyInPandas(compare, "fp binary, to binary, links long"), "near-inside")

    edges = links.select("a", "b").unionByName(inside.select(F.col("fp").alias("a"), F.col("to").alias("b")))
    joined = components(edges)
    counts = links.select(F.col("a").alias("fp"), F.col("copies_b").alias("k")).unionByName(links.select(F.col("b").alias("fp"), F.col("copies_a").alias("k"))).unionByName(inside.select("fp", F.col("links").alias("k"))).groupBy("fp").agg(F.sum("k").alias("links"))
    known = reps.select("fp", "copies", "least").join(joined, "fp", "left").join(counts, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = known.groupBy("root").agg(F.min("least").alias("class_id"))
    texts_of = stored(known.join(heads, "root").select("fp", F.hex("root").alias("class_key"), "class_id", F.col("least").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")), "near-classes")
    linked = every.where("n > 0").select("doc_id", "text_key", "fp").join(texts_of, "fp").select("doc_id", "class_id", "n_links", "copy_id", "text_key", "class_key")
    alone = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_key").cast("string"))
    return linked.unionByName(every.where("n = 0").select("doc_id", "text_key", alone.alias("class_key"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id")))


def distinct_texts(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: of the least doc_id, and where several rows of the class share that id, one of them.

    All columns stay, whatever they are called. Null doc_ids, empty, long and
    repeated texts, ties and empty tables as in ``classes``: of equal rows one
    stays, and every empty text under an id of its own.
    """
    k_id, k_key, k_text, k_row = free_names(docs, "k_id", "k_key", "k_text", "k_row")
    heads = classes(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_key", "class_id").agg(F.min("text_key").alias("least")).select(F.col("class_id").alias(k_id), F.col("least").alias(k_key))
    columns = docs.columns
    mine = docs.withColumn(k_text, F.xxhash64("text")).join(heads, F.col("doc_id").cast("long").eqNullSafe(F.col(k_id)) & (F.col(k_text) == F.col(k_key)))
    one = Window.partitionBy(k_id, k_key).orderBy(k_id)
    return mine.withColumn(k_row, F.row_number().over(one)).where(F.col(k_row) == 1).select(*(F.col(f"`{c}`") for c in columns))
