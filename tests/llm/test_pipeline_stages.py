"""The pipeline end to end on a small corpus with planted cases."""

from collections import Counter

import corpus_pipeline
import pytest
from helpers import DOC, linked, prose, words

from docloom.llm import mixing, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    texts = [prose(60 + k % 50, k) for k in range(80)]
    texts += [texts[3], texts[3] + " more", "### $$$ %%% " * 60, texts[5] + " write to who@where.org now", prose(60, 999) + " who@where.org"]
    rows = [(k, t, "en", f"src{k % 5}", len(t)) for k, t in enumerate(texts)] + [(500, None, None, None, None)]
    spark.createDataFrame(rows, DOC).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(80)] + [(82, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen.append((name, docs))
        if name != "best-fit packing":
            assert docs.columns == names
    good, single, clean, mixed, packed = (df.collect() for _, df in seen)
    held = {r.doc_id: r for r in docs_of(spark, folder)}
    kept = {r.doc_id for r in good}
    trusted = [k for k in range(80)]
    assert len(good) == len(kept) and not kept & {82, 500} and len(kept & set(trusted)) >= 77
    # one row of each class, of the least id, by all pairs
    ids = sorted(kept)
    roots, _ = linked([held[k].text for k in ids])
    assert sorted(r.doc_id for r in single) == sorted({ids[k] for k in roots}) and 81 not in {r.doc_id for r in single}
    # base spans go, all else stays as it was
    assert {r.doc_id: r.text for r in clean} == {r.doc_id: r.text.replace("who@where.org", "[EMAIL]") for r in single}
    # every leaf takes its budget, each text in a run of whole epochs and one more for a prefix
    times = Counter(r.doc_id for r in mixed)
    plan = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(clean, DOC)).collect()}
    assert times == {k: r.repeats for k, r in plan.items() if r.repeats}
    # all tokens are packed, into bins that hold no source and no text twice
    words_of = {r.doc_id: len(words(r.text)) for r in clean}
    assert sum(r.piece_tokens for r in packed) == sum(words_of[k] * n for k, n in times.items())
    bins = {}
    for r in packed:
        bins.setdefault(r.bin_id, []).append(r)
    source = {r.doc_id: r.source for r in clean}
    for own in bins.values():
        assert sum(r.piece_tokens for r in own) == own[0].bin_tokens <= 2048
        assert len({source[r.doc_id] for r in own}) == len(own) == len({r.doc_id for r in own})


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def test_run_and_registration(spark, folder):
    import __spark_entry__

    by_hand = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        by_hand = stage(spark, by_hand, folder)
    sums = lambda df: sorted(map(tuple, df.groupBy("doc_id").sum("piece_tokens").collect()), key=str)
    assert sums(corpus_pipeline.run(spark, folder)) == sums(by_hand)
    found = __spark_entry__.queries()
    assert "pipeline" in found and [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []
