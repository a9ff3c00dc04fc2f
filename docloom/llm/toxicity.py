"""Toxicity scores: a learned lexicon in a trie, met by Levenshtein automata, weighed by the quotations they stand in."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stored, text_of

#: Marks that open or close a quotation, and the marks that each of them can close.
QUOTES = "\"“”„«»‘’"
CLOSES = {'"': '"', "“": "„", "”": "“„”", "»": "«", "«": "»", "’": "‘"}
#: What may stand before an opening mark but for white space.
OPENERS = "([{-–—:/“„«‘"
FEATURES = ("exact", "fuzzy", "quoted", "rate", "strongest")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def errors_allowed(term: str) -> int:
    """Edits by length; a stem, which lets any ending follow, takes more letters for the first."""
    n = len(term)
    if term.endswith("*"):
        return 0 if n < 9 else 1
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """Levenshtein automaton of one word: a state is a row of edit distances, capped one above the limit."""

    def __init__(self, word: str, limit: int):
        self.word, self.limit = word, limit
        self.start = tuple(min(k, limit + 1) for k in range(len(word) + 1))

    def step(self, state: tuple, char: str) -> tuple:
        cap, row = self.limit + 1, [min(state[0] + 1, self.limit + 1)]
        for k, own in enumerate(self.word):
            row.append(min(state[k] + (own != char), state[k + 1] + 1, row[k] + 1, cap))
        return tuple(row)

    def alive(self, state: tuple) -> bool:
        return min(state) <= self.limit


class Lexicon:
    """Terms and their weights in a trie. A term that ends in ``*`` is a stem: any ending may follow it."""

    def __init__(self, weights: dict[str, float], clean: frozenset[str] = frozenset()):
        self.weights, self.clean = weights, clean
        self.root: dict = {}
        for term, weight in weights.items():
            node = self.root
            for char in term.rstrip("*"):
                node = node.setdefault(char, {})
            node.setdefault("", []).append((term, weight))
        self.stems = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
        self.stem_lengths = sorted({len(t) for t in self.stems}, reverse=True)
        self.known: dict[str, tuple[float, bool] | None] = {}
        self.filter = self._filter()

    def _filter(self) -> str:
        """A pattern that every word within reach of a term matches: of a term cut in one piece more than errors allowed, one piece stays whole."""
        parts = set()
        for term in self.weights:
            bare, stem = term.rstrip("*"), term.endswith("*")
            d = errors_allowed(term)
            cuts = [len(bare) * k // (d + 1) for k in range(d + 2)]
            for k in range(d + 1):
                piece, end = re.escape(bare[cuts[k] : cuts[k + 1]]), "$" if k == d and not stem else ""
                low, high = max(0, cuts[k] - d), cuts[k] + d
                if k == 0:
                    parts.add(f"^{piece}" + ("$" if d == 0 and not stem else ""))
                else:
                    parts.add((f"^.{{{low},{high}}}" if not end else "") + piece + end)
        return "|".join(sorted(parts)) or "^$"

    def match(self, word: str) -> tuple[float, bool] | None:
        """(weight, whether exact) of the strongest term the word is within reach of."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > 500_000:
            self.known.clear()
        found = self.known[word] = self._match(word)
        return found

    def _match(self, word: str) -> tuple[float, bool] | None:
        exact = [self.weights[word]] if word in self.weights else []
        exact += [self.stems[word[:n]] for n in self.stem_lengths if word[:n] in self.stems]
        if exact:
            return max(exact), True
        if word in self.clean:
            return None
        best = None
        auto = Automaton(word, 2)
        stack = [(self.root, auto.start, 0)]
        while stack:
            node, state, depth = stack.pop()
            for term, weight in node.get("", ()):
                off = min(state) if term.endswith("*") else state[-1]
                if off <= errors_allowed(term) and (best is None or weight > best):
                    best = weight
            for char, child in node.items():
                if char and auto.alive(after := auto.step(state, char)):
                    stack.append((child, after, depth + 1))
        return None if best is None else (best, False)


def quotations(text: str) -> list[tuple[int, int]]:
    """Bounds of the outermost quotations of a whole text, in order.

    Marks are paired by kind and direction. A straight mark or ``«`` opens where a
    word follows a space, a bracket or another opening mark; else a mark closes
    what it can, and opens if there is nothing. A single mark between two letters
    or digits is an apostrophe, and ``’`` never opens. A mark that is never
    closed, or closes nothing (5"), makes no quotation.
    """
    held: list[tuple[str, int]] = []
    count = dict.fromkeys(QUOTES, 0)
    found: list[tuple[int, int]] = []
    for m in re.finditer(f"[{QUOTES}]", text):
        q, at = m[0], m.start()
        left, right = text[at - 1 : at] if at else " ", text[at + 1 : at + 2] or " "
        if q in "‘’" and left.isalnum() and right.isalnum():
            continue
        opens = (left.isspace() or left in OPENERS) and not right.isspace()
        if not (opens and q in '"«') and any(count[o] for o in CLOSES.get(q, "")):
            while True:  # marks opened inside and never closed go with it
                o, start = held.pop()
                count[o] -= 1
                if o in CLOSES[q]:
                    break
            while found and found[-1][0] > start:
                found.pop()
            found.append((start, at))
        elif q in "“„«‘" or (opens and q in '"”»') or (q == '"' and (right.isalpha() or (left.isspace() and right.isspace()))):
            held.append((q, at))
            count[q] += 1
    return found


def features(text: str, hits: dict[str, tuple[float, bool]], n_words: int) -> list[float]:
    """FEATURES of one text whose hit words (lower case) are given with weight and exactness."""
    exact = fuzzy = quoted = strongest = 0.0
    low = text.lower()
    quotes = quotations(low)
    for m in re.finditer(r"[^\W_]+", low):
        got = hits.get(m[0])
        if got is None:
            continue
        k = bisect_left(quotes, (m.start(),)) - 1
        inside = k >= 0 and m.start() < quotes[k][1]
        if inside:
            quoted += 1
        elif got[1]:
            exact += 1
        else:
            fuzzy += 1
        strongest = max(strongest, got[0] * (0.25 if inside else 1.0) * (1.0 if got[1] else 0.7))
    return [np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), 100 * (exact + 0.5 * fuzzy) / (n_words + 50), strongest]


def feature_rows(texts, lexicon: Lexicon) -> np.ndarray:
    """FEATURES of an Arrow array of texts; distinct words are met once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern_regex(pc.utf8_lower(texts), pattern=r"[^\p{L}\p{N}]+")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    likely = np.flatnonzero(pc.match_substring_regex(flat.dictionary, pattern=lexicon.filter).to_numpy(zero_copy_only=False))
    words = flat.dictionary.take(pa.array(likely)).to_pylist()
    found = {k: (w, got) for k, w in zip(likely.tolist(), words, strict=True) if w and (got := lexicon.match(w)) is not None}
    out = np.zeros((len(counts), len(FEATURES)))
    if found:
        which = flat.indices.to_numpy(zero_copy_only=False)
        hit = np.zeros(len(flat.dictionary), bool)
        hit[list(found)] = True
        doc = np.repeat(np.arange(len(counts)), counts)
        where = np.flatnonzero(hit[which])
        for d in np.unique(doc[where]):
            own = dict(found[int(k)] for k in np.unique(which[where[doc[where] == d]]))
            out[d] = features(texts[int(d)].as_py(), own, int(counts[d]))
    return out


def slices(batch, most: int = 4 << 20):
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(size // most)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps; the bias comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def term_counts(sample: DataFrame, stems: bool) -> DataFrame:
    """(term, p, q): toxic groups and clean texts that hold each word, or stem of 4 to 8 letters.

    Near copies must not vote more than once, so toxic texts count by the least
    hash of their long words, which copies share.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    sample = sample.select("toxic", "doc_id", words.alias("w"))
    group = F.coalesce(F.array_min(F.transform(F.filter("w", lambda w: F.char_length(w) >= 8), lambda w: F.xxhash64(w))), F.xxhash64("doc_id"))
    cut = lambda w: F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.least(F.lit(8), F.char_length(w) - 1))), lambda k: F.concat(F.substring(w, F.lit(1), k), F.lit("*")))
    terms = F.array_distinct(F.flatten(F.transform(F.filter("w", lambda w: F.char_length(w) > 4), cut))) if stems else F.col("w")
    # the group before the explosion, else it is worked out for every term
    sample = sample.select("toxic", F.when(F.col("toxic") == 1, group).alias("grp"), terms.alias("terms"))
    rows = sample.select("toxic", "grp", F.explode("terms").alias("term"))
    # clean texts fall together map-side; of toxic ones each group leaves one row
    once = rows.groupBy("term", "toxic", "grp").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("term").agg(F.sum("toxic").alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))


class Model:
    """Lexicon and weights; small and bounded, so it travels with the tasks."""

    def __init__(self, weights: dict[str, float], clean: list[str], w: np.ndarray):
        self.weights, self.clean, self.w = weights, clean, w

    def key(self) -> tuple:
        return tuple(sorted(self.weights.items())), tuple(self.clean)


@lru_cache(maxsize=1)
def lexicon_of(key: tuple) -> Lexicon:
    return Lexicon(dict(key[0]), frozenset(key[1]))


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 6000, terms: int = 1000, least_gain: float = 30.0, least_ratio: float = 20.0) -> Model:
    """Lexicon and weights from at most ``sample_rows`` labelled texts of either class outside the held-out third.

    Terms are words and stems whose log-likelihood ratio and rate among toxic
    texts are high, at most ``terms`` of them, a stem only where it says more
    than its best word. In one half of the sample (by hash), words of clean texts
    within reach of a term are noted as clean; the other half fits the weights of
    the features, so that misspellings weigh what they are worth on unseen words.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").cast("long").alias("toxic")).where(~held_out(F.col("l_id")))
    pick = marked.withColumn("o", F.xxhash64("l_id"))
    picked = pick.where("toxic = 1").orderBy("o", "l_id").limit(sample_rows).unionByName(pick.where("toxic = 0").orderBy("o", "l_id").limit(sample_rows))
    # two times sample_rows ids at most
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic", F.pmod("o", F.lit(2)).alias("half"))
    sample = stored(sample, "toxicity-sample")
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    big_p, big_q = totals.get(1, 0), totals.get(0, 0)
    if not big_p or not big_q:
        return Model({}, [], np.array([*[0.0] * len(FEATURES), -3.0]))
    n = float(big_p + big_q)
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    gain = 2 * (p * F.log(p * n / ((p + q) * big_p)) + F.when(q > 0, q * F.log(q * n / ((p + q) * big_q))).otherwise(0.0))
    ratio = ((p + 0.5) / (big_p + 1.0)) / ((q + 0.5) / (big_q + 1.0))
    strong = term_counts(sample, False).unionByName(term_counts(sample, True)).where(p >= 3).withColumn("gain", gain).withColumn("ratio", ratio)
    rows = strong.where((F.col("gain") >= least_gain) & (F.col("ratio") >= least_ratio)).orderBy(F.desc("gain"), "term").limit(terms).collect()  # bounded by ``terms``
    gains = {r.term: r.gain for r in rows}
    words = {t: g for t, g in gains.items() if not t.endswith("*")}
    keep: dict[str, float] = {}
    for t in sorted((t for t in gains if t.endswith("*")), key=lambda t: (-gains[t], len(t), t)):
        bare = t[:-1]
        if any(bare.startswith(k[:-1]) or k[:-1].startswith(bare) for k in keep):
            continue
        if gains[t] > 1.3 * max((g for w, g in words.items() if w.startswith(bare)), default=0.0):
            keep[t] = gains[t]
    # a word stays beside its stem, for it allows edits within the stem that a short stem does not
    chosen = words | keep
    top = max(chosen.values(), default=1.0)
    weights = {t: float(0.5 + 0.5 * g / top) for t, g in chosen.items()}
    bare_lexicon = (tuple(sorted(weights.items())), ())

    def near(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        lexicon = Lexicon(dict(bare_lexicon[0]))
        seen: set[str] = set()
        for batch in batches:
            flat = pc.split_pattern_regex(pc.utf8_lower(batch.column(0)), pattern=r"[^\p{L}\p{N}]+").flatten().unique()
            flat = flat.filter(pc.match_substring_regex(flat, pattern=lexicon.filter))
            new = {w for w in flat.to_pylist() if w and (got := lexicon.match(w)) is not None and not got[1]} - seen
            seen |= new
            yield pa.RecordBatch.from_pydict({"word": sorted(new)}, schema=pa.schema([("word", pa.string())]))

    # words of the bounded sample that lie near one of the bounded terms
    clean = sorted(r.word for r in sample.where("toxic = 0 and half = 0").select("text").mapInArrow(near, "word string").distinct().collect())
    model = Model(weights, clean, np.zeros(len(FEATURES) + 1))
    key = model.key()

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                x = feature_rows(part.column(1), lexicon_of(key))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=["toxic", *FEATURES])

    rows = sample.where("half = 1").select("toxic", "text").mapInArrow(measure, "toxic long, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()  # bounded by the sample
    if len(rows):
        x, y = rows[list(FEATURES)].to_numpy(), rows["toxic"].to_numpy(float)
        # what only quotes a term shall not count for abuse
        x = np.vstack([x, np.zeros((1, len(FEATURES)))])
        model.w = fitted(x, np.append(y, 0.0))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text).

    Every word of every text is held against the lexicon: exact, by stem, or
    within the edit distance its length allows. Null and empty texts score as
    texts without a hit. Null doc_ids are not held out. Repeated rows score
    alike. An empty table gives an empty result. Other columns are not read.
    """
    key, w = model.key(), model.w

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                x = feature_rows(part.column(1), lexicon_of(key))
                p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], names=["doc_id", "score"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
