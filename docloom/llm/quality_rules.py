"""Quality rules whose thresholds come from mergeable quantile sketches. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACES, stored, text_of, words_of

#: Rates that speak against a document when high, with the spread that counts at least: where a group's quartiles (nearly) coincide, the fence still leaves clean rows room.
RATES = {"symbol_rate": 0.02, "upper_rate": 0.05, "dup_line_rate": 0.2, "repeat_rate": 0.15}
#: The same for the mean word length, fenced on both sides.
LENGTH_SPREAD = 0.5
METRICS = [*RATES, "mean_length"]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are sorted by hash with their position, so equal ones lie side by
    side: n log n in the words of a text, however often they repeat. Windows are
    told apart by 64-bit hash within one text.
    """

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        windows = F.sort_array(F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return let(F.sort_array(F.transform(let(windows, twice), lambda e: e["i"])), covered)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, count)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and every count and rate of each text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", text_of("text").alias("t"))
    rows = rows.select("*", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", "\\p{Lu}", ""))).cast("long").alias("n_upper"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double")).otherwise(F.lit(0.0))
    return rows.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_rate"),
        share("n_upper", "word_chars").alias("upper_rate"),
        share("n_dup_lines", "n_lines").alias("dup_line_rate"),
        share("n_repeat_words", "n_words").alias("repeat_rate"),
        share("word_chars", "n_words").alias("mean_length"),
    )


def fences(rows: DataFrame, *, k: int, reach: float, least_rows: int) -> DataFrame:
    """A row per (lang, source): the fences of its metrics.

    One KLL sketch per (lang, source) and metric over the rows that pass the base
    rules; sketches merge to languages and to the whole. A group of fewer than
    ``least_rows`` rows takes its language's quartiles, a thin language the
    corpus's. Sketches are made map-side, so a hot source costs no shuffle.
    """
    fit = rows.where(~F.col("base_failed"))
    own = fit.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in METRICS))
    own = stored(own, "quality-sketches")
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in METRICS)]
    quartiles = lambda df, keys: df.select(*keys, "n", *(F.kll_sketch_get_quantile_double(m, F.lit(q)).alias(f"{m}_{int(q * 100)}") for m in METRICS for q in (0.25, 0.75)))
    names = [f"{m}_{q}" for m in METRICS for q in (25, 75)]
    a = quartiles(own, ["lang", "source"])
    b = quartiles(own.groupBy("lang").agg(*merged), ["lang"]).select(F.col("lang").alias("b_lang"), F.col("n").alias("b_n"), *(F.col(x).alias(f"b_{x}") for x in names))
    c = own.agg(*merged, F.max(F.when(F.col("n") > 0, "*")).alias("c_key"))
    c = quartiles(c.where("c_key is not null"), ["c_key"]).select("c_key", *(F.col(x).alias(f"c_{x}") for x in names))
    groups = rows.select("lang", "source").distinct().withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    wide = groups.join(a, F.col("g_lang").eqNullSafe(F.col("lang")) & F.col("g_source").eqNullSafe(F.col("source")), "left").join(b, F.col("g_lang").eqNullSafe(F.col("b_lang")), "left")
    thin = F.when((F.coalesce("n", F.lit(0)) < least_rows) & (F.coalesce("b_n", F.lit(0)) < least_rows), "*")
    wide = wide.withColumn("g_thin", thin).join(c, F.col("g_thin") == F.col("c_key"), "left")
    value = lambda x: F.when(F.col("n") >= least_rows, F.col(x)).when(F.col("b_n") >= least_rows, F.col(f"b_{x}")).otherwise(F.col(f"c_{x}"))
    high = lambda m, least: (value(f"{m}_75") + reach * F.greatest(value(f"{m}_75") - value(f"{m}_25"), F.lit(least)))
    low = lambda m, least: (value(f"{m}_25") - reach * F.greatest(value(f"{m}_75") - value(f"{m}_25"), F.lit(least)))
    return wide.select("g_lang", "g_source", *(high(m, s).alias(f"{m}_max") for m, s in RATES.items()), low("mean_length", LENGTH_SPREAD).alias("mean_length_min"), high("mean_length", LENGTH_SPREAD).alias("mean_length_max"))


def judge(docs: DataFrame, *, k: int = 4096, reach: float = 3.0, least_rows: int = 50, salts: int = 16) -> DataFrame:
    """Counts, base rules and the adaptive verdict for each row of ``docs`` (doc_id, text, lang, source).

    A row is kept if it passes the base rules and each metric lies within its
    group's fences: quartile plus (for word length also minus) ``reach`` times
    the spread between quartiles. The join to the fences is salted, for one
    source may hold a third of the rows.

    Null texts are empty and fail. Null lang or source make groups of their own.
    Repeated rows are judged each. An empty table gives an empty result. Other
    columns are not read. Sketches are exact up to ``k`` rows a group and off by
    about 0.1 % in rank beyond.
    """
    rows = stored(measured(docs), "quality-rows")
    limits = fences(rows, k=k, reach=reach, least_rows=least_rows).select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("g_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    joined = salted.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("salt") == F.col("g_salt")), "left")
    within = (F.col("mean_length") >= F.col("mean_length_min")) & (F.col("mean_length") <= F.col("mean_length_max"))
    for m in RATES:
        within = within & (F.col(m) <= F.col(f"{m}_max"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(within, F.lit(True)))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *METRICS, *(f"{m}_max" for m in METRICS), "mean_length_min")
