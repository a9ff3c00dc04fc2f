"""Quality classifier: interpolated modified Kneser-Ney character n-grams, across words, trained on trusted text."""

from __future__ import annotations

from collections import OrderedDict
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ceil_div, free_names, opened, stored, text_of, words_of

#: Longest n-gram. A text is START, a space, and its words, each followed by one space.
ORDER = 5
START = "\x02"
#: Characters scored at a time.
WINDOW = 1 << 19
#: Split of trusted texts: rows whose crc32(doc_id) leaves 0 set the quantiles, the rest train.
FOLDS = 4
SHARD_ROWS = 4_000_000


# --- training: count joins in the DataFrame API --------------------------------------------------


def pieces(words: Column) -> Column:
    """array<struct<s, at>>: each word with the characters before it that its n-grams reach back to; ``at`` is the place (from 1) of its first character."""
    tail = ORDER - 2

    def piece(w: Column, i: Column) -> Column:
        # a word before of one character lets the one before that be seen, for words are as short as one
        far = F.when(i == 1, F.lit(START)).otherwise(F.substring(F.coalesce(F.get(words, i - 2), F.lit("")), -tail, tail))
        near = F.concat(far, F.lit(" "), F.get(words, i - 1))
        before = F.when(i == 0, F.lit(START)).otherwise(F.substring(near, -tail, tail))
        return F.struct(F.concat(before, F.lit(" "), w, F.lit(" ")).alias("s"), (F.char_length(before) + 2).alias("at"))

    return F.transform(words, piece)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, g, c): n-grams of the longest order, and shorter ones from a text's start, with their counts, summed map-side."""
    once = F.get(F.transform(F.array(words_of(text_of("text"))), pieces), F.lit(0))  # the words are cut once
    rows = texts.select("lang", F.explode(once).alias("p")).select("lang", F.col("p.s").alias("s"), F.col("p.at").alias("at"))
    cut = F.transform(F.sequence("at", F.char_length("s")), lambda i: F.substring("s", F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i, F.lit(ORDER))))
    return rows.select("lang", F.explode(cut).alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("c"))


def discounts(levels: dict[int, DataFrame]) -> DataFrame:
    """Per level and language the three discounts from the counts of counts; where these are too thin, 0.5, 1 and 1.5.

    Counts of counts are summed map-side, and the result, a row a level and
    language, is stored: joins to it then know its size, and no n-gram is dealt
    by its language.
    """
    n = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def one(k: int, plain: float) -> Column:
        a, b = F.col(f"n{k}"), F.col(f"n{k + 1}")
        d = k - (k + 1) * y * b / a
        return F.when((a > 0) & (b > 0) & (F.col("n1") > 0) & (d > 0) & (d < k), d).otherwise(F.lit(plain)).alias(f"d{k}")

    every = [level.select(F.lit(k).alias("d_n"), "lang", "c") for k, level in levels.items()]
    with_n = reduce(DataFrame.unionByName, every).groupBy("d_n", "lang").agg(*n)
    safe = with_n.select("d_n", "lang", *(F.when(F.col(f"n{k}") > 0, F.col(f"n{k}")).alias(f"n{k}") for k in (1, 2, 3, 4)))  # null instead of 0: no division by it
    return stored(safe.select("d_n", F.col("lang").alias("d_lang"), one(1, 0.5), one(2, 1.0), one(3, 1.5)), "kn-discounts")


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log-probabilities (lang, g, lp) of all n-grams and back-off weights (lang, h, bo) of all contexts.

    Below the longest order an n-gram counts the distinct characters before it,
    but from a text's start, where nothing comes before, its occurrences. A level
    joins its counts with its contexts' sums and with the probabilities of the
    level below.
    """
    raw = stored(gram_counts(texts.withColumn("lang", F.coalesce("lang", F.lit("")))), "kn-raw")
    levels = {ORDER: raw.where(F.char_length("g") == ORDER)}
    for n in range(ORDER - 1, 0, -1):
        after = levels[n + 1].groupBy("lang", F.substring("g", 2, n).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        levels[n] = stored(after.unionByName(raw.where((F.char_length("g") == n) & F.startswith("g", F.lit(START)))), "kn-level")
    size = levels[1].groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("v"))
    cuts = discounts(levels)
    below = stored(size.select("lang", F.lit("").alias("g"), (-F.log(F.col("v").cast("double"))).alias("lp")), "kn-p0")
    grams, contexts = below, None
    for n in range(1, ORDER + 1):
        own = levels[n].join(cuts.where(F.col("d_n") == n), F.col("lang") == F.col("d_lang")).drop("d_lang", "d_n")
        own = own.withColumn("h", F.substring("g", 1, n - 1)).withColumn("low", F.substring("g", 2, n - 1))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        ctx = stored(own.groupBy("lang", "h").agg(F.sum("c").cast("double").alias("total"), F.sum(cut).alias("kept_back")).withColumn("gamma", F.col("kept_back") / F.col("total")), "kn-contexts")
        up = below.select(F.col("lang").alias("l_lang"), F.col("g").alias("l_g"), F.col("lp").alias("l_lp"))
        sums = ctx.select(F.col("lang").alias("c_lang"), F.col("h").alias("c_h"), "total", "gamma")
        p = own.join(sums, (F.col("lang") == F.col("c_lang")) & (F.col("h") == F.col("c_h"))).join(up, (F.col("lang") == F.col("l_lang")) & (F.col("low") == F.col("l_g")))
        below = stored(p.select("lang", "g", F.log((F.col("c") - cut) / F.col("total") + F.col("gamma") * F.exp("l_lp")).alias("lp")), "kn-p")
        grams = grams.unionByName(below)
        rest = ctx.select("lang", "h", F.log("gamma").alias("bo"))
        contexts = rest if contexts is None else contexts.unionByName(rest)
    return grams, contexts


# --- hashing shared by the tables and the texts ---------------------------------------------------


def lang_seed(lang: str | None) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang or ""))


def finish(rolled: np.ndarray, n: int, seeds, kind: int) -> np.ndarray:
    """Signed 64-bit key of n-grams of one length; kind 0 for probabilities, 1 for contexts.

    The first 12 bits are the language's and the next 4 the length's and kind's,
    so that sorted keys of one language and length lie together: what a batch
    looks up lies in few files.
    """
    with np.errstate(over="ignore"):
        x = rolled ^ (seeds + np.uint64(2 * n + kind + 1) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))) >> np.uint64(16)
        return (x | (seeds & np.uint64(0xFFF << 52)) | np.uint64((2 * n + kind) << 48)).view(np.int64)


BASE = np.uint64(0x100000001B3)


def gram_keys(langs: list[str], grams: list[str], kind: int) -> np.ndarray:
    out = np.zeros(len(grams), np.int64)
    seeds = np.array([lang_seed(x) for x in langs], np.uint64)
    lengths = np.fromiter(map(len, grams), np.int64, len(grams))
    for n in range(ORDER + 1):
        at = np.flatnonzero(lengths == n)
        if not len(at):
            continue
        points = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n).astype(np.uint64) if n else np.zeros((len(at), 0), np.uint64)
        rolled = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                rolled = rolled * BASE + points[:, k] + np.uint64(1)
        out[at] = finish(rolled, n, seeds[at], kind)
    return out


def sharded(grams: DataFrame, contexts: DataFrame) -> list[tuple[str, int, int, int]]:
    """Both tables as sorted files by ranges of the key; (path, least key, largest key, rows) of each file."""

    def keyed(frames):
        for frame in frames:
            for kind, part in frame.groupby("kind"):
                yield pd.DataFrame({"key": gram_keys(part["lang"].tolist(), part["g"].tolist(), int(kind)), "value": part["value"].astype("float32")})

    both = grams.select("lang", "g", F.col("lp").alias("value"), F.lit(0).alias("kind")).unionByName(contexts.select("lang", F.col("h").alias("g"), F.col("bo").alias("value"), F.lit(1).alias("kind")))
    table = stored(both.mapInPandas(keyed, "key long, value float"), "kn-keys")
    parts = max(1, ceil_div(table.count(), SHARD_ROWS))
    table = stored(table.repartitionByRange(parts, "key").sortWithinPartitions("key"), "kn-shards")
    # a row a file, of SHARD_ROWS rows each
    rows = table.groupBy(F.input_file_name().alias("path")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    return sorted(((r.path, r.lo, r.hi, r.n) for r in rows), key=lambda r: r[1])


class Shards:
    """Joins keys to the sorted shards. Up to ``resident`` rows stay in memory; beyond, shards are read as they are met."""

    def __init__(self, files: tuple, resident: int = 12_000_000):
        self.files, self.resident, self.held = files, resident, OrderedDict()

    def load(self, path: str):
        import pyarrow.parquet as pq

        if path in self.held:
            self.held.move_to_end(path)
            return self.held[path]
        system, name = opened(path)
        table = pq.read_table(name, filesystem=system)
        got = table.column("key").to_numpy(), table.column("value").to_numpy()
        self.held[path] = got
        while len(self.held) > 1 and sum(len(k) for k, _ in self.held.values()) > self.resident:
            self.held.popitem(last=False)
        return got

    def values(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, nan for unknown ones."""
        unique, codes = np.unique(keys, return_inverse=True)  # ascending keys meet a sorted shard in one sweep
        found = np.full(len(unique), np.nan, np.float32)
        for path, lo, hi, _ in self.files:
            a, b = np.searchsorted(unique, lo), np.searchsorted(unique, hi, side="right")
            if a < b:
                known, value = self.load(path)
                at = np.minimum(np.searchsorted(known, unique[a:b]), len(known) - 1)
                found[a:b] = np.where(known[at] == unique[a:b], value[at], found[a:b])
        return found[codes]


@lru_cache(maxsize=1)
def shards_of(files: tuple) -> Shards:
    """One model a Python worker, kept across tasks."""
    return Shards(files)


def text_scores(texts: list[str], seeds: np.ndarray, model: Shards) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability and number of characters of each text (words one space apart); nan where its language has no model.

    Texts are laid end to end and scored ``WINDOW`` characters at a time, so a
    long text takes no more memory than its characters.
    """
    points = np.frombuffer("".join(f"{START} {t} " for t in texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 3
    starts = np.cumsum(sizes) - sizes
    sums, counts = np.zeros(len(texts)), np.where(sizes > 3, sizes - 2, 0)
    for a in range(0, len(points), WINDOW):
        low, stop = max(0, a - ORDER + 1), min(len(points), a + WINDOW)
        own = np.arange(low, stop)
        doc = np.searchsorted(starts, own, side="right") - 1
        place, seed, mine = own - starts[doc], seeds[doc], points[low:stop].astype(np.uint64)
        rolled = [np.zeros(len(mine), np.uint64)]
        with np.errstate(over="ignore"):
            for n in range(1, ORDER + 1):  # over the n characters that end here: the n-1 before the last one, then it
                prev = np.zeros(len(mine), np.uint64)
                prev[1:] = rolled[n - 1][:-1]
                rolled.append(prev * BASE + mine + np.uint64(1))
        scored = np.flatnonzero((place > 1) & (own >= a) & (sizes[doc] > 3))
        # a character's score is that of its language and the characters up to it, ORDER at most: each such run is looked up once
        run = rolled[ORDER][scored]
        for n in range(1, ORDER):
            early = place[scored] == n - 1
            run[early] = rolled[n][scored[early]]
        codes, runs = pd.factorize(run ^ seed[scored])
        at = np.empty(len(runs), np.int64)
        at[codes] = scored  # any one place of each run
        score = np.zeros(len(runs), np.float32)
        open_ = np.arange(len(runs))
        for n in range(ORDER, -1, -1):
            use = open_[place[at[open_]] >= n - 1] if n else open_
            if len(use):
                got = model.values(finish(rolled[n][at[use]], n, seed[at[use]], 0))
                hit = ~np.isnan(got)
                score[use[hit]] += got[hit]
                if n:
                    miss = use[~hit]  # back off: the weight of the n-1 characters before
                    back = model.values(finish(rolled[n - 1][at[miss] - 1] if n > 1 else rolled[0][at[miss]], n - 1, seed[at[miss]], 1))
                    score[miss] += np.nan_to_num(back, nan=0.0)
                open_ = np.setdiff1d(open_, use[hit], assume_unique=True)
        score[open_] = np.nan  # no model of this language
        sums += np.bincount(doc[scored], weights=score[codes], minlength=len(texts))
    return sums, counts


def score(docs: DataFrame, files: list[tuple], *, slice_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, lang, n_chars_scored and perplexity of each text, over all its characters, runs of white space as one space."""
    known = tuple(files)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        model = shards_of(known)
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(size // slice_bytes)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if b <= a:
                    continue
                part = batch.slice(a, b - a)
                texts = pc.ascii_trim_whitespace(pc.replace_substring_regex(part.column(2), pattern="[ \\t\\n\\x0b\\x0c\\r]+", replacement=" "))
                langs = pc.fill_null(part.column(1), "").dictionary_encode()
                seeds = np.array([lang_seed(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy(zero_copy_only=False)]
                total, chars = text_scores(texts.to_pylist(), seeds, model)
                with np.errstate(divide="ignore", invalid="ignore"):
                    ppl = np.exp(-total / chars)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(chars), pa.array(ppl, mask=~np.isfinite(ppl))], names=["doc_id", "lang", "text_key", "n_chars_scored", "perplexity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_of("text").alias("text"), F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, lang string, text_key long, n_chars_scored long, perplexity double")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.99, broadcast_ids: int = 4_000_000) -> DataFrame:
    """doc_id, perplexity, its language's threshold and whether the text is kept.

    Trusted are the rows of ``labels`` (doc_id, quality) with quality 1. All of
    them but every fourth (by crc32) train the model, one per language; of those
    set aside, each language's ``quantile`` of perplexity is its threshold, up to
    which a text is kept. Trusted ids are broadcast up to ``broadcast_ids`` (8
    bytes each); beyond, the texts are joined by shuffle.

    Null or empty texts, and those of white space only, have no perplexity and
    are rejected. Texts in a language (null counts as one) without trusted texts
    have none either and are kept; so are those of a language whose trusted texts
    all train. Very long texts are scored whole, ``WINDOW`` characters at a time.
    A text on the threshold is kept. Repeated rows are scored each and train
    each; a doc_id labelled twice is trusted if any label says so. Null doc_ids
    are never trusted. Empty labels keep every text that is not empty, empty
    documents give an empty result. Other columns, whatever their names, are not
    read.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("t_id")).distinct()
    small = trusted.count() <= broadcast_ids
    bounded = lambda ids: F.broadcast(ids) if small else ids
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    texts = plain.join(bounded(trusted.where(fold(F.col("t_id")) != 0)), F.col("doc_id") == F.col("t_id"), "left_semi")
    files = sharded(*train(texts))
    scored = stored(score(plain, files), "kn-scores")
    aside = scored.join(bounded(trusted.where(fold(F.col("t_id")) == 0)), F.col("doc_id") == F.col("t_id"), "left_semi")
    limits = aside.where("perplexity is not null").groupBy(F.coalesce("lang", F.lit("")).alias("l_lang")).agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000)).alias("threshold"))
    # a row a language; stored, so that its size is known to the join
    out = scored.join(stored(limits, "kn-limits"), F.coalesce("lang", F.lit("")) == F.col("l_lang"), "left")
    kept = F.when(F.col("n_chars_scored") == 0, F.lit(False)).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return out.select("doc_id", "lang", "text_key", "n_chars_scored", "perplexity", "threshold", kept.alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all columns, whatever else they are called.

    Equal rows have one verdict. Nulls, empty, long and repeated texts, ties and
    empty tables as in ``classify``.
    """
    judged = classify(docs, labels, **options)
    q_id, q_lang, q_key = free_names(docs, "q_id", "q_lang", "q_key")
    bad = judged.where(~F.col("kept")).select(F.col("doc_id").alias(q_id), F.col("lang").alias(q_lang), F.col("text_key").alias(q_key)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(q_id)) & F.col("lang").eqNullSafe(F.col(q_lang)) & (F.xxhash64("text") == F.col(q_key))
    return docs.join(bad, same, "left_anti")
