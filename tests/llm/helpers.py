"""Small corpora and brute-force twins."""

import random
import re

from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "iota", "lambda"]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(spark, texts, extra=True):
    """Documents of given texts; nulls, an empty and a repeated row, and clashing extra columns come along."""
    rows = [(k, t, ["en", "fr"][k % 2], f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    if extra:
        rows += [(1000, None, None, None, None), (1001, "", "en", "src0", 0), (None, "alone with no number at all here", "en", "src1", 5), rows[0], rows[0]]
    df = spark.createDataFrame(rows, DOC)
    if extra:
        for name in ("bucket", "salt", "fp", "n", "w", "t", "h", "cap", "row_key", "text_key", "shard", "kept"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(texts, threshold=0.8):
    """Least index of each text's class, and links of each, by all pairs."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))], links
