"""Each operator against brute force, an exact round trip or planted cases, with awkward rows."""

import hashlib
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from helpers import DOC, corpus, linked, prose, words

from docloom.llm import kneser_ney, mixing, near_dup, packing, pii, quality_rules, tokens, topk, toxicity, warc
from docloom.llm.common import on_workers


@pytest.fixture(autouse=True)
def importable(spark):
    on_workers(spark)


def empty(spark):
    return spark.createDataFrame([], DOC)


# --- 1 mixing


def test_budgets_redistribute_among_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 1, 10), ("a", "en", "s2", 1, 1000), ("a", "fr", "s3", 1, 1000), ("b", "en", "s4", 1, 100)], "domain string, lang string, source string, docs long, supply long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, {}, 0.5, 1).collect()}
    # total 1055: b fills up at 100, a gets 955; en and fr of a get 477.5 each; s1 fills up at 10 and its sibling s2 takes the rest
    assert got == {"s1": 10, "s2": 467, "s3": 477, "s4": 100}


def test_mix_takes_the_least_prefix_that_reaches_the_budget(spark):
    df = corpus(spark, [prose(5 + k % 7, k) for k in range(60)])
    rows = mixing.mix(df, {"lang": {"en": 3.0}}, share=1.0, max_epochs=3, bucket_docs=5).collect()
    assert len(rows) == df.count()
    leaves = {}
    for r in rows:
        leaves.setdefault((r.domain, r.lang, r.source), []).append(r)
    for own in leaves.values():
        budget, supply = own[0].leaf_budget, sum(r.n_tokens for r in own)
        taken = sum(r.n_tokens * r.repeats for r in own)
        longest = max(r.n_tokens for r in own)
        assert budget <= 3 * supply and budget <= taken < budget + max(longest, 1) and sum(r.taken_tokens for r in own) == budget
        assert max(r.repeats for r in own) - min(r.repeats for r in own) <= 1
    assert mixing.mix(empty(spark)).count() == 0
    odd = df.withColumn("m_id", near_dup.F.lit(1)).withColumn("M_key", near_dup.F.lit(1)).withColumn("m_turn", near_dup.F.lit(1)).withColumn("budget", near_dup.F.lit(1))
    out = mixing.mixed(odd, max_epochs=3)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} <= {r.doc_id for r in rows} and mixing.mixed(empty(spark)).count() == 0
    # a leaf of one text of 30,000 words, and one of empty texts
    long = mixing.mix(corpus(spark, [prose(30_000, 1), "", " ", prose(10, 2)], extra=False), share=0.5, max_epochs=1).collect()
    assert sum(r.taken_tokens for r in long) == sum(r.leaf_budget for r in {(r.domain, r.lang, r.source): r for r in long}.values())


# --- 2 top-k


def test_topk_is_exact(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(400, 8))
    data[50:60] = data[40]  # ties
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (5, [float(x) for x in data[5]])]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in topk.search(df, df.where("vec_id % 20 = 0"), 5, shard_rows=64, block_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    q = np.floor(data * 256).astype(np.int64)
    for query in range(0, 400, 20):
        scores = sorted(((-int(q[query] @ q[k]), k) for k in range(400) if k != query))[:5]
        assert got[query] == [(k, -s) for s, k in scores]
    few = df.where("vec_id < 3")
    assert topk.search(few, few.where("vec_id = 0"), 5).count() == 2
    none = df.where("vec_id < 0")
    assert topk.search(none, none, 5).count() == 0


def test_topk_is_exact_over_rounds(spark, monkeypatch):
    """Many shards a task and one, several rounds and parts; ties, zeros, numbers beyond float32 and float64, another number of components."""
    rng = np.random.default_rng(2)
    data = np.floor(rng.normal(size=(900, 6)) * 40)
    data[100:400] = data[7]  # one very common vector
    data[500:520] = 0
    data[600:640] *= 1 << 14
    data[700:703] *= 1 << 40
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)] + [(k, [float(k % 3)]) for k in range(900, 1000, 25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(k, [int(x) for x in v]) for k, v in rows]
    wanted = []
    for q, a in whole:
        if q % 25 == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), k) for k, b in whole if k != q and len(a) == len(b))
            wanted += [(q, i + 1, k, -s) for i, (s, k) in enumerate(scores[:5])]
    for shards, blocks, shard_rows in ((16, 32, 128), (1, 1, 32)):
        monkeypatch.setattr(topk, "SHARDS_A_TASK", shards)
        monkeypatch.setattr(topk, "BLOCKS_A_TASK", blocks)
        got = topk.search(df, df.where("vec_id % 25 = 0"), 5, shard_rows=shard_rows, block_rows=7).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == wanted


def test_topk_asks_many_queries_at_once(spark, tmp_path):
    """1e9 pairs, a quarter of the vectors one and the same: seconds of products, not of calls a query and row."""
    rng = np.random.default_rng(3)
    n = 240_000
    data = np.floor(rng.normal(size=(n, 64)) * 32)
    data[::4] = data[0]
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(data)}).to_parquet(tmp_path / "vectors.parquet")
    df = spark.read.parquet(str(tmp_path / "vectors.parquet"))
    began = time.time()
    got = topk.search(df, df.where("vec_id % 50 = 0"), 5).toPandas().sort_values(["query_id", "rank"])
    assert time.time() - began < 40
    assert len(got) == 5 * n // 50
    for q in range(0, n, 4_000):
        scores = (data @ data[q]).astype(np.int64)
        scores[q] = np.iinfo(np.int64).min
        best = np.lexsort((np.arange(n), -scores.astype(float)))[:5]
        mine = got[got["query_id"] == q]
        assert list(mine["vec_id"]) == list(best) and list(mine["score"]) == list(scores[best])


# --- 3 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def test_base_spans_match_the_patterns(spark):
    texts = ["a@b.c_d@e.f x..y@z-.q.r. 1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1", "+1 (017) 555-7713 4785380592391139 4785-3805 9239 1139 +4785380592391139", "é😀 a@b.cc 9 9999 12 " + "7" * 5000, "+12345678901.a@b.co é" * 50, "no data"]
    df = corpus(spark, texts)
    for r in pii.digest(pii.find(df)).collect():
        if r.doc_id is None:
            continue
        t = texts[r.doc_id] if r.doc_id < 1000 else ""
        want = sorted((m.start(), o, m.end(), k) for o, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t, re.ASCII) if passes(k, m[0]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in PATTERNS]
    assert pii.find(empty(spark)).count() == 0


def test_disclosing_terms_are_found_and_taken_out(spark):
    texts = ["the zebrafish wrote to m@x.org today", "the zebrafish then wrote m@x.org a note"] + [f"the note of today wrote then a to {prose(6, k)}" for k in range(60)]
    df = corpus(spark, texts, extra=False)
    found = {r.doc_id: r.spans for r in pii.digest(pii.find(df)).collect()}
    at = texts[0].index("zebrafish")
    assert found[0] == f"remove:{at}:{at + 9},email:{texts[0].index('m@')}:{texts[0].index('m@') + 7}" and found[5] == ""
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert clean[0].text == "the  wrote to [EMAIL] today" and clean[0].n_chars == len(clean[0].text) and clean[7].text == texts[7]
    odd = corpus(spark, texts)
    for name in ("p_key", "P_row", "p_spans", "p_text", "spans", "terms", "salt_", "entity"):
        odd = odd.withColumn(name, near_dup.F.lit(1))
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and out.count() == len(texts) + 5 and pii.sanitise(empty(spark)).count() == 0


def brute_disclosures(texts, generalise=0.8, remove=0.95, support=2, evidence=6.0):
    """{(text, term): kind} by counting over all rows."""
    from collections import defaultdict
    from math import log

    def masked_words(t):
        spans = [m.span() for k, p in PATTERNS.items() for m in re.finditer(p, t, re.ASCII) if passes(k, m[0])]
        return {m[0].lower() for m in re.finditer(r"[^\W_]+", t) if not any(a < m.end() and m.start() < b for a, b in spans)}

    def entities(t):
        out = set()
        for o, (k, p) in enumerate(PATTERNS.items()):
            for m in re.finditer(p, t, re.ASCII):
                if passes(k, m[0]):
                    v = m[0].lower() if o < 2 else re.sub("[^0-9]", "", m[0])
                    out |= {str(o), f"{o}:{v}", f"{o}/" + (v.split("@")[-1], v.rsplit(".", 1)[0], v[:6], v[:-7])[o]}
        return out

    n = len(texts)
    holds, both, n_t = defaultdict(list), defaultdict(list), defaultdict(int)
    for t in texts:
        own = masked_words(t)
        for w in {m[0].lower() for m in re.finditer(r"[^\W_]+", t)}:
            n_t[w] += 1
        for e in entities(t):
            holds[e].append(t)
            for w in own:
                both[e, w].append(t)
    out = {}
    for (e, w), met in both.items():
        n_e = len(holds[e])
        pmi, ic = log(len(met) * n / (n_e * n_t[w])), log(n / n_e)
        if len(set(met)) >= support and ic > 0 and len(met) * pmi >= evidence and pmi / ic >= generalise:
            for t in set(met):
                out[t, w] = max(out.get((t, w), ""), "remove" if pmi / ic >= remove else "generalise")
    return out


def test_disclosure_is_that_of_the_counts(spark):
    import random

    rng = random.Random(6)
    texts = []
    for k in range(400):
        body = prose(25, k).split()
        if k % 5 == 0:
            g = k // 5 % 8
            body[rng.randrange(25)] = [f"u{k}@firm{g}.org", f"10.0.{g}.{k % 200}", f"+1 (70{g}) 555-{3000 + k}"][g % 3]
            body[rng.randrange(25)] += f" Team{g}"
            body.append(f"rare{k % 10}")
        elif k % 23 == 0:
            body.append(f"team{k % 4}")
        texts.append(" ".join(body))
    texts += [texts[5], texts[5], texts[10], texts[11]]
    want = {}
    for (t, w), kind in brute_disclosures(texts, support=2).items():
        for m in re.finditer(rf"(?<![^\W_]){w}(?![^\W_])", t, re.I):
            want.setdefault(t, set()).add(f"{kind}:{m.start()}:{m.end()}")
    got = {texts[r.doc_id]: {s for s in r.spans.split(",") if s.startswith(("remove", "general"))} for r in pii.digest(pii.find(corpus(spark, texts, extra=False))).collect()}
    assert {t: s for t, s in got.items() if s} == want and len(want) > 20 and {s.split(":")[0] for x in want.values() for s in x} == {"remove", "generalise"}


@pytest.mark.parametrize("bits", [64, 1 << 12, pii.BITS])
def test_filter_keeps_all_told_pairs(spark, monkeypatch, bits):
    monkeypatch.setattr(pii, "BITS", bits)
    every = [(f"e{k % 7}" if k % 11 else None, f"word{k}") for k in range(3000)]
    pairs, told = (spark.createDataFrame(rows, "entity string, term string") for rows in (every + every[:50], every[::60]))
    got = [tuple(r) for r in pii.likely_told(pairs, told).select("entity", "term").collect()]
    assert all(got.count(p) == (2 if p in every[:50] else 1) for p in every[::60])
    assert bits < 100 or len(got) < 200
    assert pii.likely_told(pairs, told.limit(0)).count() == 0


def test_terms_far_from_their_entity_are_taken_out_everywhere(spark):
    far = [prose(90, 300 + k) for k in range(4)]
    texts = [f"Zebrafish {far[0]} é😀 m@x.org, +4785380592391139 {far[1]} (zebrafish) end", f"{far[2]} m@x.org {far[3]} ZEBRAFISH a ZEBRAFISHm@x.org"] + [f"a end {far[k % 4]} {prose(90, 500 + k)}" for k in range(60)]
    df = corpus(spark, texts, extra=False)
    found = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    for k in (0, 1):
        spans = {tuple(map(int, s.split(":")[1:])) for s in found[k].spans.split(",") if s.startswith("remove:")}
        want = {m.span() for m in re.finditer("zebrafish(?!m)", texts[k], re.I)}
        assert spans == want and found[k].n_terms == len(want) == (2, 1)[k]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zebrafish" not in (clean[0] + clean[1]).lower() and clean[9] == texts[9]


# --- 4 quality classifier


def marked(text):
    return kneser_ney.START + " " + " ".join(words(text)) + " "


def brute_kneser_ney(trained, text, order=kneser_ney.ORDER):
    """Log-probability of a text by the textbook recursion."""
    from collections import Counter, defaultdict
    from math import log

    raw = Counter()
    for s in (marked(t) for t in trained if words(t)):
        for i in range(2, len(s)):
            raw[s[max(0, i - order + 1) : i + 1]] += 1
    counts = {order: {g: c for g, c in raw.items() if len(g) == order}}
    for n in range(order - 1, 0, -1):
        level = Counter(g[1:] for g in counts[n + 1])
        level.update({g: c for g, c in raw.items() if len(g) == n and g.startswith(kneser_ney.START)})
        counts[n] = dict(level)
    disc, ctx = {}, {}
    for n, level in counts.items():
        k = Counter(min(c, 5) for c in level.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0
        d = []
        for j, plain in ((1, 0.5), (2, 1.0), (3, 1.5)):
            v = j - (j + 1) * y * k[j + 1] / k[j] if k[j] else -1
            d.append(v if k[j] and k[j + 1] and k[1] and k[2] and 0 < v < j else plain)
        disc[n] = d
        ctx[n] = defaultdict(list)
        for g, c in level.items():
            ctx[n][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        n, h = len(g), g[:-1]
        own = ctx[n].get(h)
        if not own:
            return p(g[1:])
        cut = lambda c: disc[n][min(c, 3) - 1]
        c = counts[n].get(g, 0)
        return (max(c - cut(c), 0) if c else 0) / sum(own) + sum(map(cut, own)) / sum(own) * p(g[1:])

    s = marked(text)
    return sum(log(p(s[max(0, i - order + 1) : i + 1])) for i in range(2, len(s)))


def brute_perplexity(trained, text):
    return np.exp(-brute_kneser_ney(trained, text) / (len(marked(text)) - 2))


def test_perplexity_is_that_of_the_recursion(spark, monkeypatch):
    trusted = [prose(60, k) for k in range(6)] + ["I a b ñ c\n\ndé  I", "a", " x y ", "", "ab c"]
    texts = spark.createDataFrame([(k, t, "en") for k, t in enumerate(trusted)], "doc_id long, text string, lang string")
    files = kneser_ney.sharded(*kneser_ney.train(texts))
    probe = [(1, "alpha3 gamm delta", "en"), (2, " Xyz!\t\nñandú a I b ", "en"), (3, "alpha3", "zz"), (4, None, "en"), (5, "a", "en"), (6, " \n", "en"), (7, prose(900, 77) + " é😀 a b", "en")]
    got = {r.doc_id: r for r in kneser_ney.score(spark.createDataFrame(probe, "doc_id long, text string, lang string"), files).collect()}
    for k in (1, 2, 5, 7):
        assert got[k].perplexity == pytest.approx(brute_perplexity(trusted, probe[k - 1][1]), rel=1e-4)
    assert [got[k].perplexity for k in (3, 4, 6)] == [None] * 3 and got[4].n_chars_scored == got[6].n_chars_scored == 0
    # the same in windows that cut words and n-grams
    monkeypatch.setattr(kneser_ney, "WINDOW", 37)
    sums, n = kneser_ney.text_scores([" ".join(words(probe[k][1])) for k in (0, 1, 4, 6)], np.array([kneser_ney.lang_seed("en")] * 4), kneser_ney.Shards(tuple(files)))
    assert np.exp(-sums / n) == pytest.approx([got[k].perplexity for k in (1, 2, 5, 7)], rel=1e-4)


def test_order_of_words_counts(spark):
    import random

    sentence = "the quick fox saw a lazy dog near the old mill and ran on to it"
    trusted = [" ".join([sentence] * 3)] * 8
    files = kneser_ney.sharded(*kneser_ney.train(spark.createDataFrame([(t, "en") for t in trusted], "text string, lang string")))
    mixed = sentence.split()
    random.Random(1).shuffle(mixed)
    got = [r.perplexity for r in kneser_ney.score(spark.createDataFrame([(1, sentence, "en"), (2, " ".join(mixed), "en")], "doc_id long, text string, lang string"), files).orderBy("doc_id").collect()]
    assert got[1] > 1.3 * got[0]


def test_verdicts_follow_the_quantile_of_the_language(spark):
    texts = [prose(40, k) if k % 2 else " ".join(w[::-1] for w in prose(40, k).split()) for k in range(120)] + ["$$% ### @@! " * 30, prose(30, 999), "x"]
    df = corpus(spark, texts)
    rows = [(r.doc_id, r.lang, r.text) for r in df.collect()]
    labels = [(k, int(k % 5 != 0)) for k in range(120)] + [(None, 1), (7, 0)]
    trusted = {i for i, q in labels if q == 1 and i is not None}
    judged = kneser_ney.classify(df, spark.createDataFrame(labels, "doc_id long, quality int"), quantile=0.9).collect()
    want = []
    for lang in {x for _, x, _ in rows}:
        own = [(i, t or "") for i, x, t in rows if x == lang]
        train = [t for i, t in own if i in trusted and zlib.crc32(str(i).encode()) % 4]
        aside = sorted(brute_perplexity(train, t) for i, t in own if i in trusted and zlib.crc32(str(i).encode()) % 4 == 0)
        limit = aside[int(np.ceil(0.9 * len(aside))) - 1] if aside else None
        for i, t in own:
            want.append((str(i), bool(words(t)) and (limit is None or brute_perplexity(train, t) <= limit * (1 + 1e-5))))
    assert sorted((str(r.doc_id), r.kept) for r in judged) == sorted(want)
    assert not all(k for i, k in want if i.isdigit() and int(i) < 120)


def test_junk_is_rejected_and_clean_text_kept(spark):
    texts = [prose(80, k) for k in range(60)] + ["$$% ### @@! ~~^ " * 30, "$$% ### " * 40_000]
    df = corpus(spark, texts)
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(None, 1)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in kneser_ney.classify(df, labels, quantile=1.0).collect()}
    assert sum(kept[k] for k in range(60)) >= 57 and not any(kept[k] for k in (60, 61, 1000, 1001))
    out = kneser_ney.accepted(df.withColumn("q_id", near_dup.F.lit(1)).withColumn("Q_KEY", near_dup.F.lit(1)), labels, quantile=1.0)
    assert out.columns == [*df.columns, "q_id", "Q_KEY"] and out.where("doc_id = 0").count() == 3 * kept[0] and out.where("doc_id = 60").count() == 0
    assert kneser_ney.classify(empty(spark), labels).count() == 0 and kneser_ney.accepted(empty(spark), labels).count() == 0
    assert sorted(r.doc_id is None or r.doc_id < 1000 for r in kneser_ney.accepted(df, labels.limit(0)).collect()) == [True] * (len(texts) + 3)


# --- 5 token ids


def test_perfect_hash():
    hashes = tokens.mixed(np.arange(5000, dtype=np.uint64), 9)
    table = tokens.PerfectHash.build(hashes)
    assert sorted(table.find(hashes)) == list(range(5000))
    again, _ = tokens.PerfectHash.from_bytes(table.to_bytes())
    assert (again.find(hashes) == table.find(hashes)).all()
    raw = tokens.index_bytes(hashes, np.zeros(5000), np.arange(5000), np.ones(5000))
    assert (tokens.look_up(raw, hashes)["at"] == np.arange(5000)).all()
    with pytest.raises(KeyError):
        tokens.look_up(raw, tokens.mixed(np.arange(9000, 9500, dtype=np.uint64), 9))


def test_ids_come_back_as_the_library_gives_them(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    texts = ["Hello, World!! it's 42.", "İstanbul ΣΑΣ. naïve café… 'quoted'.", "a b\tc\n\nd", "<|endoftext|>. x", "word," * 3000, "é ́ x!", "won't. (see).", prose(300, 3)]
    df = corpus(spark, texts)
    entries = tokens.write_shards(df, path)
    got = [tuple(r) for r in tokens.read_back(entries.select("doc_id", "seen"), tokens.build_index(entries), entries).collect()]
    tool = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, start = [], 0
    for doc_id, t in rows:
        ids = [*tool.encode(t, add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    none = tokens.write_shards(empty(spark), path)
    assert tokens.read_back(none.select("doc_id", "seen"), tokens.build_index(none), none).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_text_has_the_ids_of_whole_text_encoding(name):
    import random

    import pyarrow as pa

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path(name))
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|endof", "text|>", "İ", "ǰ", "J\u030c", "H\u0331", "e\u0301", "\u0301", "\u0338", "=", "<", ">", "'s", "'S", "'", "’", "Σ", "ΑΣ", "ß", "ẞ", "\u2126", "\u212a", "\u0958", "क", "़", "\u1100\u1161", "한", "שׁ", "½", "٣", "7", "42", "the", "THE", "Ding", "éau", "É", "ñ", ".", ",", "!!", "&&&", "|", "@", "\x00", "\x01", "\x7f", "\x85", "\xa0", "\u2028", "\u3000", "\ufeff", "😀", "\u200d", "_"]
    gaps = ["", "", "", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c"]
    rng = random.Random(8)
    texts = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", " ", "a" * 3000, "İ. İ, İ!", "<|ENDOFTEXT|>."]
    tool, own = Tokenizer.from_file(path), tokens.Encoder(path, most=3000)
    assert own.by_word == (name == "word_bpe_49k.json")
    for k in range(0, len(texts), 500):
        ids, n = own.encode(pa.array(texts[k : k + 500]))
        parts = np.split(ids, np.cumsum(n)[:-1])
        for t, got in zip(texts[k : k + 500], parts, strict=True):
            assert got.tolist() == [*tool.encode(t, add_special_tokens=False).ids, tokens.END_ID], repr(t)


# --- 6 packing


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 60, 300)]
    sources, clusters = [int(x) for x in rng.integers(0, 9, 300)], [int(x) for x in rng.integers(0, 40, 300)]
    bins, offsets, used = packing.best_fit(sizes, sources, clusters, 100)
    held = []  # the same rule by looking at every bin
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        fit = [(100 - sum(sizes[j] for j in b), k) for k, b in enumerate(held) if sum(sizes[j] for j in b) + sizes[i] <= 100 and all(sources[j] != sources[i] and clusters[j] != clusters[i] for j in b)]
        k = min(fit)[1] if fit else len(held)
        if not fit:
            held.append([])
        assert bins[i] == k and offsets[i] == sum(sizes[j] for j in held[k])
        held[k].append(i)
    assert used == [sum(sizes[j] for j in b) for b in held]


def test_pack_keeps_every_token(spark):
    texts = [prose(1 + (k * 37) % 300, k) for k in range(80)] + [prose(900, 99)]
    df = corpus(spark, texts)
    rows = packing.pack(df, 256, shard_rows=30).collect()
    total = sum(len(words(r.text)) for r in df.collect())
    assert sum(r.piece_tokens for r in rows) == total
    assert sorted(r.piece for r in rows if r.doc_id == 80) == [0, 1, 2, 3]
    filled = {}
    for r in rows:
        if r.bin_id is not None:
            filled[r.bin_id] = filled.get(r.bin_id, 0) + r.piece_tokens
    assert max(filled.values()) <= 256 and all(r.bin_tokens == filled[r.bin_id] for r in rows if r.bin_id is not None)
    assert [r.bin_id for r in rows if r.doc_id in (1000, 1001)] == [None, None]
    assert packing.pack(empty(spark)).count() == 0


# --- 7 warc


def test_archives_round_trip(spark):
    big = "<p>" + prose(400, 1) + "é</p>"
    rows = [(1, "http://a/1", big), (2, "http://a/2\n x", big), (3, None, "short"), (4, "u", "short"), (5, "u", None), (7, "u", big), (None, "u", big), (9, "u", "<p>" + prose(300, 2)), (7, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_back(warc.archive(pages, files=2)).collect()
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = sorted((str(i), len((h or "").encode()), sha(h), "revisit" if h == big and i != 7 else "response", 7 if h == big and i != 7 else None) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.read_back(warc.archive(pages.limit(0))).count() == 0


# --- 8 toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automata_find_what_the_distance_allows():
    import random

    rng = random.Random(4)
    terms = {"idiot": 1.0, "disgusting": 0.9, "scum": 0.8, "vequab*": 0.7}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(3000):
        base = list(rng.choice([t.rstrip("*") for t in terms]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(base) + 1)
            if rng.random() < 0.5:
                base.insert(at, rng.choice("abcdeist"))
            elif at < len(base):
                del base[at]
        word = "".join(base)
        want = any((distance(word, t) <= toxicity.errors_allowed(t)) if not t.endswith("*") else word.startswith(t[:-1]) for t in terms)
        assert (lexicon.match(word) is not None) == want, word
        assert not want or re.search(lexicon.filter, word), word


def test_toxic_texts_score_high_and_quotation_less(spark):
    texts = [prose(40, k) + (" you stupid moron, go " if k % 4 == 0 else " ") + prose(20, k + 500) for k in range(240)]
    texts += [prose(30, 7001) + " you stupit morron " + prose(30, 7002), prose(30, 7003) + ' he said "stupid moron" then ' + prose(30, 7004), prose(30, 7005) + " you stupid moron " + prose(30, 7006)]
    df = corpus(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(240)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    assert {"stupid", "moron"} <= set(model.weights)
    rows = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for k in range(240):
        assert rows[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and rows[k].predicted == int(k % 4 == 0)
    assert rows[241].score < rows[242].score and 0 <= rows[1000].score < 0.7
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.learn(df, labels.limit(0)).weights == {}


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ("You’re an idiot and you don’t know", 0),
        ("‘You’re an idiot’, he said, and it’s idiot", 1),
        ("“" + "long words " * 40 + "idiot " + "long words " * 40 + "” idiot", 1),
        ('"' + "long words " * 40 + 'idiot" idiot ' + "long words " * 40 + '"b"', 1),
        ('a 5" screen idiot and a 7" one', 0),
        ("„idiot“ idiot „b“ «idiot» idiot « idiot » »idiot« idiot »b« ”idiot” idiot", 5),
        ("“a “idiot” idiot” idiot", 2),
        ('"one\n\n"idiot two" idiot', 1),
        ('("idiot") idiot ("b")', 1),
        ("“never closed idiot", 0),
        ('" idiot " idiot "Stop!"idiot say"idiot"', 2),
        ("she said: “he said ‘idiot’ to me, idiot” idiot’s", 2),
    ],
)
def test_quotation_is_told_over_the_whole_text(text, quoted):
    every = len(re.findall("idiot", text))
    x = toxicity.features(text, {"idiot": (1.0, True)}, 10)
    assert round(float(np.expm1(x[2]))) == quoted and round(float(np.expm1(x[0]))) == every - quoted


# --- 9 near duplicates


def near_corpus():
    texts = []
    for k in range(12):
        base = prose(90, k).split()
        texts.append(" ".join(base))
        for v in range(k % 5):
            copy = list(base)
            copy[(v * 17) % 90] = "changed"
            if v == 3:
                copy = copy[:70]
            texts.append(" ".join(copy))
        if k % 3 == 0:
            texts.append(" ".join(base))
    return texts + ["two words", "two words", "one", "a b c d e f", "a b c d e f g"]


@pytest.mark.parametrize("crowd", [1, 16])
def test_classes_match_all_pairs(spark, crowd):
    texts = near_corpus()
    df = corpus(spark, texts, extra=False).withColumn("fp", near_dup.F.lit(1))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.classes(df, crowd=crowd, chunk=5).collect()}
    roots, links = linked(texts)
    assert got == {k: (roots[k], links[k]) for k in range(len(texts))}


def test_one_row_of_each_class_stays(spark):
    df = corpus(spark, near_corpus())
    for name in ("k_id", "K_Key", "k_text", "k_row", "class_id", "root"):
        df = df.withColumn(name, near_dup.F.lit(1))
    out = near_dup.distinct_texts(df)
    assert out.columns == df.columns
    roots, _ = linked(near_corpus())
    kept = sorted(r.doc_id for r in out.where("doc_id < 1000").collect())
    assert kept == sorted(set(roots)) and out.where("doc_id in (1000, 1001)").count() == 2 and out.where("doc_id is null").count() == 1
    assert near_dup.classes(empty(spark)).count() == 0 and near_dup.distinct_texts(empty(spark)).count() == 0


def test_components_with_hot_roots(spark):
    import random

    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 700)] + [(1000 + k, 1001 + k) for k in range(0, 60, 2)] + [(1000 + k, 1003 + k) for k in range(0, 40, 2)] + [(5000 + rng.randrange(300), 5000 + rng.randrange(300)) for _ in range(200)]
    name = lambda k: k.to_bytes(4, "big")
    got = {int.from_bytes(r.fp, "big"): int.from_bytes(r.root, "big") for r in near_dup.components(spark.createDataFrame([(bytearray(name(b)), bytearray(name(a))) for a, b in edges], "a binary, b binary")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_unlinked_texts_of_null_or_one_id_all_stay(spark):
    texts = [prose(40, 900 + k) for k in range(24)]
    ids = [None] * 12 + [7] * 12
    rows = [(i, t, "en", "src0", len(t)) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[0], rows[12], (None, texts[12], "en", "src0", 1), (7, "", "en", "src0", 0), (8, "", "en", "src0", 0), (8, "", "en", "src0", 0), (None, None, "en", "src0", None)]
    got = sorted((str(r.doc_id), r.text or "") for r in near_dup.distinct_texts(spark.createDataFrame(rows, DOC)).collect())
    assert got == sorted([(str(i), t) for i, t in zip(ids, texts, strict=True)] + [("7", ""), ("8", ""), ("None", "")])


def test_sketching_holds_few_words_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = [prose(300, k) for k in range(40)] * 80
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    n = [len(near_dup.shingle_sets(part.column(1))[1]) - 1 for part in near_dup.pieces(batch)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n) == len(texts) and batch.nbytes > 6 << 20 and most < 30 << 20


def test_bands_are_not_sorted_and_unwanted_texts_not_dealt(spark, monkeypatch):
    plans, inner = {}, near_dup.stored

    def told(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return inner(df, name)

    monkeypatch.setattr(near_dup, "stored", told)
    # the tables of a test would all be broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near_dup.classes(corpus(spark, near_corpus()), crowd=1, chunk=5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortAggregate" not in plans["near-bands"] and "HashAggregate" in plans["near-bands"]
    below = plans["near-sets"].split("Exchange hashpartitioning(coalesce(doc_id")[1]
    assert "BroadcastHashJoin" in below


def test_wanted_ids_pass_the_filter_and_few_others(spark):
    rows = spark.range(-5000, 5000).selectExpr("id as doc_id", "'x' as text").unionByName(spark.createDataFrame([(None, "y")], "doc_id long, text string"))
    ids = spark.range(-5000, 5000, 100).selectExpr("id as want").unionByName(spark.createDataFrame([(None,)], "want long"))
    got = [r.doc_id for r in near_dup.maybe_wanted(rows, ids).collect()]
    wanted = {None, *range(-5000, 5000, 100)}
    assert wanted <= set(got) and len(got) == len(set(got)) <= len(wanted) + 20
    assert near_dup.maybe_wanted(rows, ids.limit(0)).count() == 0


def test_posterior_rule():
    rules = near_dup.least_matches(0.8, 1e-6)
    assert all(0 < m < n for n, m in rules) and rules == sorted(rules)


# --- 10 quality rules


def test_counts_match_brute_force(spark):
    texts = ["a b c a b c x", "x " * 60, "l1 w\nl1 w\n\n \nl2\n", "#tag $5 50% a|b <i>", "\x0b\x0cé😀 z", prose(200, 1), "w1 w2 w3 w4 w1 w2 w3 w9 w2 w3 w4", "one two three four five " * 12]
    df = corpus(spark, texts)
    for r in quality_rules.judge(df).collect():
        if r.doc_id is None:
            continue
        t = texts[r.doc_id] if r.doc_id < 1000 else ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(empty(spark)).count() == 0


def test_thresholds_follow_the_group(spark):
    texts = [prose(80, k) for k in range(90)] + [" ".join(w + "$$$" for w in prose(80, 5).split())]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(corpus(spark, texts, extra=False), least_rows=10).collect()}
    assert all(kept[k] for k in range(90)) and not kept[90]
