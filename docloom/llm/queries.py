"""Queries of the training-data operators over the whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import kneser_ney, mixing, near_dup, packing, pii, quality_rules, tokens, topk, toxicity, warc
from docloom.llm.common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_key")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    entries = tokens.write_shards(table(spark, sf_dir, "documents"), tokenizer)
    return tokens.read_back(entries.select("doc_id", "seen"), tokens.build_index(entries), entries)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.archive(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.learn(documents, table(spark, sf_dir, "labels")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents")).drop("text_key", "class_key")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_exact_topk": op2_exact_topk,
    "op3_pii": op3_pii,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_ids": op5_token_ids,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES = {
    "op1_source_mixing": """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         CASE WHEN regexp_extract(source, '([0-9]{1,9})$', 1) = '' OR source IS NULL THEN 'other'
              ELSE 'domain' || (regexp_extract(source, '([0-9]{1,9})$', 1)::BIGINT % 4) END AS domain
  FROM documents
), r AS (
  SELECT doc_id, domain, lang, source, len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM d
), leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS supply, 4 * sum(n_tokens)::DOUBLE AS cap FROM r GROUP BY ALL
), wd(domain, w) AS (VALUES ('domain0', 4.0::DOUBLE), ('domain1', 3), ('domain2', 2), ('domain3', 1), ('other', 1)),
wl(lang, w) AS (VALUES ('en', 6.0::DOUBLE), ('fr', 2), ('de', 2), ('es', 1)),
c1 AS (SELECT domain, cap, w, cap / w AS ratio FROM (SELECT domain, sum(cap) AS cap FROM leaf GROUP BY domain) JOIN wd USING (domain)),
l1 AS (
  SELECT *, (least((SELECT sum(supply) FROM leaf), sum(cap) OVER ()) - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS lev
  FROM c1 WINDOW p AS (ORDER BY ratio, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s1 AS (
  SELECT domain, least(cap, coalesce(w * (SELECT arg_min(lev, ratio) FROM l1 WHERE ratio > lev), cap)) AS above FROM l1
), c2 AS (
  SELECT domain, lang, cap, coalesce(w, 1) AS w, cap / coalesce(w, 1) AS ratio, above
  FROM (SELECT domain, lang, sum(cap) AS cap FROM leaf GROUP BY domain, lang) JOIN s1 USING (domain) LEFT JOIN wl USING (lang)
), l2 AS (
  SELECT *, (above - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER p, 0)) AS lev
  FROM c2 WINDOW p AS (PARTITION BY domain ORDER BY ratio, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f2 AS (SELECT domain, arg_min(lev, ratio) AS stand FROM l2 WHERE ratio > lev GROUP BY domain),
s2 AS (SELECT l2.domain, lang, least(cap, coalesce(w * f2.stand, cap)) AS above FROM l2 LEFT JOIN f2 USING (domain)),
l3 AS (
  SELECT leaf.*, (above - coalesce(sum(cap) OVER p, 0)) / (count(*) OVER (PARTITION BY domain, lang) - coalesce(count(*) OVER p, 0)) AS lev
  FROM leaf JOIN s2 USING (domain, lang)
  WINDOW p AS (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f3 AS (SELECT domain, lang, arg_min(lev, cap) AS stand FROM l3 WHERE cap > lev GROUP BY domain, lang),
b AS (
  SELECT domain, lang, source, supply::BIGINT AS supply, floor(least(cap, coalesce(f3.stand, cap)) + 1e-6)::BIGINT AS budget FROM l3 LEFT JOIN f3 USING (domain, lang)
), e AS (SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs FROM b),
o AS (
  SELECT r.*, budget, epochs, budget - epochs * supply AS rest,
         coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || epochs || ':' || doc_id), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM r JOIN e USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget, (epochs + (ahead < rest)::BIGINT)::BIGINT AS repeats,
       (epochs * n_tokens + least(greatest(rest - ahead, 0), n_tokens))::BIGINT AS taken_tokens FROM o
""",
    "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_quality_rules": """
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
a AS (
  SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), g AS (
  SELECT *, len(w) AS n, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS grams FROM a
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM (
        SELECT doc_id, unnest(range(1, len(grams) + 1)) AS i, unnest(grams) AS gram FROM g))
    WHERE c >= 2) GROUP BY doc_id
), m AS (
  SELECT doc_id, lang, source, n::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(t) - length(regexp_replace(t, '\\p{Lu}', '', 'g')) AS n_upper
  FROM g LEFT JOIN rep USING (doc_id)
), x AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS m1,
         CASE WHEN word_chars > 0 THEN n_upper::DOUBLE / word_chars ELSE 0 END AS m2,
         CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS m3,
         CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS m4,
         CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS m5
  FROM m
), q AS (
  SELECT lang, source, grouping(source) AS gs, grouping(lang) AS gl, count(*) AS n,
         quantile_disc(m1, [0.25, 0.75]) AS q1, quantile_disc(m2, [0.25, 0.75]) AS q2, quantile_disc(m3, [0.25, 0.75]) AS q3,
         quantile_disc(m4, [0.25, 0.75]) AS q4, quantile_disc(m5, [0.25, 0.75]) AS q5
  FROM x WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())
), y AS (
  SELECT x.*, CASE WHEN a.n >= 50 THEN [a.q1, a.q2, a.q3, a.q4, a.q5] WHEN b.n >= 50 THEN [b.q1, b.q2, b.q3, b.q4, b.q5] ELSE [c.q1, c.q2, c.q3, c.q4, c.q5] END AS q
  FROM x LEFT JOIN (SELECT * FROM q WHERE gs = 0) a ON x.lang IS NOT DISTINCT FROM a.lang AND x.source IS NOT DISTINCT FROM a.source
  LEFT JOIN (SELECT * FROM q WHERE gs = 1 AND gl = 0) b ON x.lang IS NOT DISTINCT FROM b.lang
  LEFT JOIN (SELECT * FROM q WHERE gl = 1) c ON true
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(
    m1 <= q[1][2] + 3 * greatest(q[1][2] - q[1][1], 0.02) AND m2 <= q[2][2] + 3 * greatest(q[2][2] - q[2][1], 0.05)
    AND m3 <= q[3][2] + 3 * greatest(q[3][2] - q[3][1], 0.2) AND m4 <= q[4][2] + 3 * greatest(q[4][2] - q[4][1], 0.15)
    AND m5 <= q[5][2] + 3 * greatest(q[5][2] - q[5][1], 0.5) AND m5 >= q[5][1] - 3 * greatest(q[5][2] - q[5][1], 0.5), true) AS kept
FROM y
""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS top FROM k WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NULL OR page_id = top THEN NULL ELSE top END AS refers_to
FROM k LEFT JOIN g USING (payload_digest)
""",
}
