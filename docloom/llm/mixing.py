"""Mixing sources to target weights by a budget that flows down a domain-language-source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import free_names, n_words_of, stored, text_of

LEVELS = ("domain", "lang", "source")
#: Weights of the registered query; what is not named weighs 1.
WEIGHTS = {"domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}, "lang": {"en": 6.0, "fr": 2.0, "de": 2.0, "es": 1.0}, "source": {}}


def default_domain(source: Column) -> Column:
    """Sources named by a number fall into four domains; others into ``other``."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(F.coalesce(digits, F.lit("")) == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), F.pmod(digits.try_cast("long"), F.lit(4)).cast("string")))


def weight_of(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(out)
    return out


def poured(nodes: DataFrame, parents: list[str], own: str, total: Column) -> DataFrame:
    """Adds ``share``: what each node gets of its parent's ``total``.

    Shares follow the weights ``w``; a node that cannot use its share gets its
    ``cap`` and the shortage goes to its siblings by weight, over and over. In
    order of cap / w the nodes that fill up come first, so the level at which the
    rest stand is that of the first node that does not fill up.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    order = by.orderBy("ratio", F.col(own).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = nodes.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(0.0)))
    df = df.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.greatest(F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0.0)), F.lit(1e-12)))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("level", F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(whole))
    return df.withColumn("share", F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap")))).drop("ratio", "level")


def budgets(leaves: DataFrame, weights: dict, share: float, max_epochs: int) -> DataFrame:
    """A row per leaf (domain, lang, source) with its supply and budget in tokens.

    A node's cap is what its leaves can give in ``max_epochs`` epochs. The budget
    goes down the tree; a shortage stays among siblings as long as their parent
    can use its share, and only what a whole subtree cannot use goes to that
    subtree's own siblings.
    """
    # a weight of 0 anywhere above takes a leaf out, so that no cap counts what cannot be given
    usable = weight_of("domain", weights) * weight_of("lang", weights) * weight_of("source", weights) > 0
    leaf = leaves.withColumn("cap", F.when(usable, F.col("supply").cast("double") * max_epochs).otherwise(F.lit(0.0)))
    up = [F.sum("cap").alias("cap"), F.sum("supply").alias("supply")]
    lang = leaf.groupBy("domain", "lang").agg(*up)
    domain = lang.groupBy("domain").agg(*up)
    total = Window.partitionBy(F.lit(1))  # a row a domain
    domain = domain.withColumn("all", F.least(F.sum("cap").over(total), F.sum("supply").over(total) * F.lit(share)))
    domain = poured(domain.withColumn("w", weight_of("domain", weights)), [], "domain", F.col("all")).select("domain", F.col("share").alias("above"))
    null_safe = lambda a, b, keys: a.join(b.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))
    lang = null_safe(lang.drop("supply"), domain, ["domain"]).withColumn("w", weight_of("lang", weights))
    lang = poured(lang, ["domain"], "lang", F.col("above")).select("domain", "lang", F.col("share").alias("above"))
    leaf = null_safe(leaf, lang, ["domain", "lang"]).withColumn("w", weight_of("source", weights))
    leaf = poured(leaf, ["domain", "lang"], "source", F.col("above"))
    return leaf.select("domain", "lang", "source", "docs", "supply", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, weights: dict | None = None, *, share: float = 1.0, max_epochs: int = 4, seed: int = 17, domain: Column | None = None, bucket_docs: int = 50_000) -> DataFrame:
    """How often each row of ``docs`` (doc_id, text, lang, source) is taken.

    The budget is ``share`` times all tokens (words). Each leaf's stream is its
    documents epoch after epoch, each epoch in a seeded order of its own; a leaf
    takes the prefix of its stream that is its budget. ``repeats`` is the number
    of times a row comes up in that prefix, ``taken_tokens`` the tokens it gives:
    the last document may give its first tokens only, so that a leaf's
    taken_tokens sum up to its budget.
    Whole epochs are counted; in the last one, a row's place in the order is
    known from sums per hash bucket of the leaf, so a leaf that holds a third of
    all rows is spread over as many tasks as it has ``bucket_docs``.

    Null lang or source are leaves of their own. Null and empty texts have no
    tokens: they come along with the prefix and never end it. A leaf without
    tokens, or with weight 0, gives nothing. Rows of one doc_id are ordered by
    text; equal rows are interchangeable. Texts count whole, however long; ties
    in a draw go by tokens, then text. An empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    weights = WEIGHTS if weights is None else weights
    place = domain if domain is not None else default_domain(F.col("source"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), place.cast("string").alias("domain"), n_words_of(text_of("text")).alias("n_tokens"), F.xxhash64("text").alias("text_key"))
    rows = stored(rows, "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("supply"))
    plan = stored(budgets(leaves, weights, share, max_epochs), "mix-budgets")
    full = F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", full).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))
    plan = plan.withColumn("digits", F.greatest(F.lit(1), F.ceil(F.log2(F.col("docs") / F.lit(float(bucket_docs))) / 4) + 1).cast("int"))
    named = plan.withColumnsRenamed({k: f"p_{k}" for k in LEVELS})
    same = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in LEVELS]
    # the leaf table is small, but its size is for the planner to judge; beyond its limit this join is split where a leaf is hot
    placed = rows.join(named, same).drop(*(f"p_{k}" for k in LEVELS), "docs")
    placed = placed.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string"))))
    placed = placed.withColumn("bucket", F.substring("draw", F.lit(1), F.col("digits")))
    keys = [*LEVELS, "bucket"]
    sums = placed.groupBy(*keys).agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held").withColumnsRenamed({k: f"s_{k}" for k in keys})
    within = Window.partitionBy(*keys).orderBy("draw", "n_tokens", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    placed = placed.join(sums, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys])
    left = F.col("rest") - F.col("base") - F.col("ahead")
    given = F.col("epochs") * F.col("n_tokens") + F.least(F.greatest(left, F.lit(0)), F.col("n_tokens"))
    return placed.select("doc_id", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), (F.col("epochs") + (left > 0).cast("long")).alias("repeats"), given.alias("taken_tokens"), "text_key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it, in whole documents; all columns are kept, whatever they are called.

    Rows equal in doc_id, lang, source and text share their repeats alike,
    rounded up. Nulls, empty and long texts, ties and empty tables as in ``mix``.
    """
    m_id, m_lang, m_source, m_key, m_times, m_turn = free_names(docs, "m_id", "m_lang", "m_source", "m_key", "m_times", "m_turn")
    taken = mix(docs, **options).where("repeats > 0").groupBy("doc_id", "lang", "source", "text_key").agg(F.sum("repeats").alias("r"), F.count(F.lit(1)).alias("c"))
    taken = taken.select(F.col("doc_id").alias(m_id), F.col("lang").alias(m_lang), F.col("source").alias(m_source), F.col("text_key").alias(m_key), F.ceil(F.col("r") / F.col("c")).cast("int").alias(m_times))
    same = F.col("doc_id").eqNullSafe(F.col(m_id)) & F.col("lang").eqNullSafe(F.col(m_lang)) & F.col("source").eqNullSafe(F.col(m_source)) & (F.xxhash64("text") == F.col(m_key))
    columns = docs.columns
    return docs.join(taken, same).withColumn(m_turn, F.explode(F.sequence(F.lit(1), F.col(m_times)))).select(*(F.col(f"`{c}`") for c in columns))
