"""Personal data: base patterns, and terms that give protected entities away. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import free_names, stored, text_of

#: Kinds in their order; the last two are terms that the method adds.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, written so that a text is scanned in one pass: a match starts where its run of characters starts, and nothing is given back.
PATTERNS = {
    "email": f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
#: Stands for a letter or digit of a base span; no letter itself.
MASK = "\ue000"
MASKED_WORD = f"[\\p{{L}}\\p{{N}}{MASK}]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def luhn(digits: Column) -> Column:
    """Whether up to 20 digits pass the check; leading zeros change nothing."""
    padded = F.lpad(digits, 20, "0")
    pairs = F.transform(F.sequence(F.lit(1), F.lit(19), F.lit(2)), lambda i: F.substring(padded, i + 1, F.lit(1)).cast("int") + F.translate(F.substring(padded, i, F.lit(1)), "0123456789", "0246813579").cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.char_length(x) < 3) | ((F.char_length(x) == 3) & (x <= "255"))))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.char_length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return F.char_length(digits).between(10, 15)


def places(text: Column, pattern: str) -> Column:
    """array<struct<m, start>>: matches with their code-point offsets, from the lengths of what lies between."""

    def offsets(both: Column) -> Column:
        return F.transform(both["m"], lambda m, i: F.struct(m.alias("m"), (F.char_length(F.array_join(F.slice(both["gaps"], F.lit(1), i + 1), "")) + F.char_length(F.array_join(F.slice(both["m"], F.lit(1), i), ""))).cast("int").alias("start")))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps")), offsets)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of the base kinds, by start, then kind."""
    mark = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}

    def of(k: int, kind: str) -> Column:
        good = F.filter(places(text, PATTERNS[kind]), lambda x: passes(kind, x["m"]))
        hits = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), (x["start"] + F.char_length(x["m"])).cast("int").alias("end"), x["m"].alias("value")))
        return F.when(mark.get(kind, F.lit(True)) & F.rlike(text, F.lit(PATTERNS[kind])), hits).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))

    found = [of(k, kind) for k, kind in enumerate(KINDS[:4])]
    return F.sort_array(F.concat(*found))


def entities_of(spans: Column) -> Column:
    """What the spans of a text protect, once each: that it holds data of a kind at all, every value in one form, and the group that a value belongs to - an address's domain, an ip's network of three numbers, a card's issuer (six digits), a phone number's area (all but seven digits)."""

    def of(s: Column) -> Column:
        digits = F.regexp_replace(s["value"], "[^0-9]", "")
        plain = F.when(s["kind"] >= 2, digits).otherwise(F.lower(s["value"]))
        group = (
            F.when(s["kind"] == 0, F.substring_index(plain, "@", -1))
            .when(s["kind"] == 1, F.substring_index(plain, ".", 3))
            .when(s["kind"] == 2, F.substring(digits, F.lit(1), F.lit(6)))
            .otherwise(F.substring(digits, F.lit(1), F.char_length(digits) - 7))
        )
        kind = s["kind"].cast("string")
        return F.array(kind, F.concat(kind, F.lit(":"), plain), F.concat(kind, F.lit("/"), group))

    return F.array_distinct(F.flatten(F.transform(spans, of)))


def masked(text: Column, spans: Column) -> Column:
    """The text with letters and digits of its spans (by start) overwritten by MASK, at the same length, so that words which overlap a span can be told."""
    bare = F.replace(text, F.lit(MASK), F.lit(" "))

    def step(a: Column, s: Column) -> Column:
        start = F.greatest(s["start"], a["end"])
        done = F.concat(a["t"], F.substring(bare, a["end"] + 1, start - a["end"]), F.regexp_replace(F.substring(bare, start + 1, s["end"] - start), "[\\p{L}\\p{N}]", MASK))
        return F.when(s["end"] > a["end"], F.struct(done.alias("t"), s["end"].alias("end"))).otherwise(a)

    return F.aggregate(spans, F.struct(F.lit("").alias("t"), F.lit(0).alias("end")), step, lambda a: F.concat(a["t"], F.substring(bare, a["end"] + 1, F.char_length(bare))))


def terms_of(mask: Column) -> Column:
    """Distinct words, in lower case, of a masked text that overlap no span."""
    words = F.array_distinct(F.regexp_extract_all(mask, F.lit(MASKED_WORD), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~F.contains(w, F.lit(MASK))), F.lower))


def found_at(mask: Column, told: Column) -> Column:
    """array<struct<start, kind, end>>: all places in a masked text of the terms of a map from term to kind."""

    def of(both: Column) -> Column:
        hits = F.filter(F.transform(both["m"], lambda m, i: F.struct(m.alias("m"), i.alias("i"), F.element_at(told, F.lower(m)).alias("kind"))), lambda x: x["kind"].isNotNull())

        def span(x: Column) -> Column:
            start = F.char_length(F.array_join(F.slice(both["gaps"], F.lit(1), x["i"] + 1), "")) + F.char_length(F.array_join(F.slice(both["m"], F.lit(1), x["i"]), ""))
            return F.struct(start.cast("int").alias("start"), x["kind"].alias("kind"), (start + F.char_length(x["m"])).cast("int").alias("end"))

        return F.transform(hits, span)

    return let(F.struct(F.regexp_extract_all(mask, F.lit(MASKED_WORD), F.lit(0)).alias("m"), F.split(mask, MASKED_WORD, -1).alias("gaps")), of)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both; equal rows have equal results, so they may share a key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("t"))
    return rows.withColumn("row_key", row_key(F.col("doc_id"), F.col("t")))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(text))


#: Parts that the rows of one entity are dealt over.
SALTS = 16


def spread(small: DataFrame) -> DataFrame:
    """A row for each part, to be joined by ``salt``."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt")


#: Bits of the filter that pairs pass before they are dealt: at most BITS / 64 rows of two longs (4 MB) go to every task, however many terms are told. Beyond some BITS told terms it lets all pass, and only the saving is gone.
BITS = 1 << 24


def marked_pairs(told: DataFrame) -> DataFrame:
    """A bit for each hash of (entity, term), by words of 64 bits."""
    at = told.select(F.pmod(F.xxhash64("entity", "term"), F.lit(BITS)).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("h") % 64).cast("int"))
    return at.groupBy(F.floor(F.col("h") / 64).cast("long").alias("at")).agg(F.bit_or(bit).alias("bits"))


def likely_told(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """Those rows of ``pairs`` (entity, term) that may be in ``told``: all that are, and of others the share of bits set."""
    h = F.pmod(F.xxhash64("entity", "term"), F.lit(BITS))
    hashed = pairs.withColumn("h", h).withColumn("at", F.floor(F.col("h") / 64).cast("long"))
    bit = F.call_function("shiftright", F.col("bits"), (F.col("h") % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    # BITS / 64 rows at most
    return hashed.join(F.broadcast(marked_pairs(told)), "at").where(bit == 1).drop("h", "at", "bits")


def disclosures(texts: DataFrame, docs: DataFrame, *, generalise: float, remove: float, support: int, evidence: float) -> tuple[DataFrame, DataFrame]:
    """(text_key, term, entity) of the entities met in ``support`` texts, and (entity, term, kind) of the terms that disclose them."""
    held = texts.select("text_key", "n", F.explode("entities").alias("entity"))
    entities = stored(held.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).select("entity", "n_e"), "pii-entities")
    # stored, as ``own`` below, so that the join knows its size: the masked texts are dealt by key only where it is large
    shared = stored(held.select("*", salt("text_key")).join(spread(entities), ["entity", "salt"]).groupBy("text_key").agg(F.collect_list("entity").alias("entities")), "pii-shared")
    words = texts.select("text_key", "n", "mask").join(shared, "text_key").select("text_key", "n", "entities", F.explode(terms_of(F.col("mask"))).alias("term"))
    met = stored(words, "pii-met").select("text_key", "n", "term", F.explode("entities").alias("entity"))
    pairs = met.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    # lower case by word, as in terms_of
    plain = F.array_distinct(F.transform(F.array_distinct(F.split(text_of("text"), "[^\\p{L}\\p{N}]+")), F.lower))
    df = docs.select(F.explode(plain).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = docs.count()
    pmi = F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t")))
    ic = F.log(F.lit(float(max(total, 1))) / F.col("n_e"))
    known = pairs.select("*", salt("term")).join(spread(entities), ["entity", "salt"]).join(df, "term").withColumn("pmi", pmi)
    known = known.where(F.col("n_et") * F.col("pmi") >= evidence).withColumn("disclosure", F.when(ic > 0, F.col("pmi") / ic).otherwise(F.lit(0.0)))
    told = known.where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure", F.when(F.col("disclosure") >= remove, F.lit(5)).otherwise(F.lit(4)).alias("kind"))
    return met, stored(told.drop("disclosure"), "pii-told")


def term_spans(base: DataFrame, docs: DataFrame, **limits) -> DataFrame:
    """(row_key, terms): all places of the terms that disclose a protected entity of their text.

    Protected are the values of the base spans, their groups and their kinds, as
    ``entities_of`` names them. The disclosure of entity e by term t is
    PMI(e; t) / IC(e): with counts of rows, log(n(e,t) N / (n(e) n(t))) / log(N /
    n(e)). At ``generalise`` a term is generalised, at ``remove`` removed, at
    every place in the texts that hold the entity. All counts are of whole texts,
    wherever in them entity and term stand. A term must be met with its entity in
    ``support`` different texts, and n(e,t) PMI, what speaks against chance, must
    reach ``evidence`` nats. Counts are summed map-side, the rows of one entity
    are dealt over SALTS parts where entities are joined. Nothing is collected;
    broadcast by hand is only a bit filter of fixed size (BITS).
    """
    dirty = base.where(F.size("spans") > 0)
    texts = stored(dirty.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.first("entities").alias("entities"), F.first("mask").alias("mask")), "pii-texts")
    met, told = disclosures(texts, docs, **limits)
    # few of the pairs met are told: the filter keeps most of the others out of the shuffle
    own = likely_told(met.select("text_key", "term", "entity"), told).join(told, ["entity", "term"]).groupBy("text_key", "term").agg(F.max("kind").alias("kind"))
    own = stored(own.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("told")), "pii-own")
    hits = texts.select("text_key", "mask").join(own, "text_key").select("text_key", found_at(F.col("mask"), F.col("told")).alias("terms"))
    return dirty.select("row_key", "text_key").distinct().join(hits, "text_key").select("row_key", "terms")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, keys and base spans, and of texts with spans the entities and the masked text."""
    rows = keyed(docs).select("doc_id", "row_key", "t", base_spans(F.col("t")).alias("spans"))
    some = F.size("spans") > 0
    return rows.select("doc_id", "row_key", F.when(some, F.md5("t")).alias("text_key"), "spans", F.when(some, entities_of(F.col("spans"))).alias("entities"), F.when(some, masked(F.col("t"), F.col("spans"))).alias("mask"))


def find(docs: DataFrame, *, generalise: float = 0.8, remove: float = 0.95, support: int = 2, evidence: float = 6.0) -> DataFrame:
    """Spans of personal data in each row of ``docs`` (doc_id, text).

    Columns doc_id, base (array of start, kind, end, value of the base patterns)
    and terms (array of start, kind, end that the method adds). Offsets count
    code points, ends are exclusive. Null texts are empty and have no spans. Null
    doc_ids take part. Texts are scanned whole, however long, in one pass.
    Repeated rows get equal spans and count each in every count but ``support``,
    which counts different texts. Spans that start together are ordered by kind.
    An empty table gives an empty result. Other columns, whatever their names,
    are not read.
    """
    base = stored(scanned(docs), "pii-rows")
    terms = term_spans(base, docs, generalise=generalise, remove=remove, support=support, evidence=evidence)
    return base.select("doc_id", "row_key", F.col("spans").alias("base")).join(terms, "row_key", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int>>")))


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    every = F.sort_array(F.concat(bare, F.col("terms")))
    return found.select("doc_id", *(count(k) for k in range(4)), F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(every).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with its spans (by start) replaced; of overlapping spans the first counts."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    clear = F.aggregate(spans, F.struct(none.alias("kept"), F.lit(0).alias("end")), lambda a, s: F.when(s["start"] >= a["end"], F.struct(F.concat(a["kept"], F.array(s)).alias("kept"), s["end"].alias("end"))).otherwise(a), lambda a: a["kept"])

    def mark(s: Column) -> Column:
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        wider = F.when(F.rlike(own, F.lit("^\\p{N}")), F.lit("[NUMBER]")).when(F.rlike(own, F.lit("^\\p{Lu}")), F.lit("[NAME]")).otherwise(F.lit("[TERM]"))
        return F.when(s["kind"] == 4, wider).when(s["kind"] == 5, F.lit("")).otherwise(F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:4])), F.least(s["kind"] + 1, F.lit(4))))

    def rebuilt(c: Column) -> Column:
        ends = lambda i: F.coalesce(F.get(c, i - 1)["end"], F.lit(0))
        body = F.transform(c, lambda s, i: F.concat(F.substring(text, ends(i) + 1, s["start"] - ends(i)), mark(s)))
        tail = F.substring(text, F.element_at(c, -1)["end"] + 1, F.char_length(text))
        return F.concat(F.array_join(body, ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(let(clear, rebuilt))


def sanitise(docs: DataFrame, *, generalise: float = 0.8, remove: float = 0.95, support: int = 2, evidence: float = 6.0) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars``, where there is one, brought up to date; all columns are kept, null texts stay null.

    Base spans become the name of their kind, disclosing terms are generalised
    ([NUMBER], [NAME], [TERM]) or removed. Of overlapping spans the first counts.
    Null doc_ids, empty, long and repeated texts, empty tables and columns of any
    name as in ``find``; every row stays.
    """
    base = stored(scanned(docs), "pii-rows")
    terms = term_spans(base, docs, generalise=generalise, remove=remove, support=support, evidence=evidence)
    dirty = base.where(F.size("spans") > 0).groupBy("row_key").agg(F.first("spans").alias("base")).join(terms, "row_key", "left")
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    p_row, p_key, p_spans, p_text = free_names(docs, "p_row", "p_key", "p_spans", "p_text")
    spans = dirty.select(F.col("row_key").alias(p_key), F.sort_array(F.concat(bare, F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias(p_spans))
    columns = docs.columns
    joined = docs.withColumn(p_row, row_key(F.col("doc_id").cast("long"), text_of("text"))).join(spans, F.col(p_row) == F.col(p_key), "left")
    clean = F.col(p_spans).isNull()
    out = joined.withColumn(p_text, F.when(clean, F.col("text")).otherwise(replaced(F.col("text"), F.col(p_spans))))
    new = {"text": F.col(p_text).alias("text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(clean, F.col("n_chars")).otherwise(F.char_length(p_text).cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return out.select(*(new[c] if c in new else F.col(f"`{c}`") for c in columns))
