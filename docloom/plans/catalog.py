"""Registered queries of the document engine, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.errors import UnsupportedOperator
from docloom.sources.collection import DuplicateKey, Engine
from docloom.sources.storage import new_path
from docloom.streaming import compile_stream

#: Tables and the column that orders each.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None,
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": None,
}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Tables(Engine):
    """The tables of a folder, read when a plan asks for them."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, {}, dict(KEYS))
        self.folder = folder

    def has(self, name: str) -> bool:
        return name in KEYS or super().has(name)

    def frame(self, name: str) -> DataFrame:
        if name not in self.tables and name in KEYS:
            self.tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return super().frame(name)


def query(name: str, table: str, pipeline: list[dict], sql: str | None = None, after=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Tables(spark, sf_dir).collection(table).aggregate(pipeline)
        return after(out) if after else out

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def rounded(*names: str):
    """Sums of doubles depend on their order in the last digits."""
    return lambda df: df.withColumns({n: F.round(n, 2) for n in names})


FLAGSHIP = [
    {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}},
    {"$unwind": "$o"},
    {"$group": {"_id": "$c_nationkey", "n": {"$sum": 1}, "total": {"$sum": "$o.o_totalprice"}}},
    {"$setWindowFields": {"sortBy": {"total": -1}, "output": {"rank": {"$rank": {}}}}},
    {"$sort": {"rank": 1}},
    {"$limit": 10},
]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by what their customers ordered."""
    return rounded("total")(Tables(spark, sf_dir).collection("customer").aggregate(FLAGSHIP))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = """
SELECT c_nationkey AS _id, count(*) AS n, round(sum(o_totalprice), 2) AS total, rank() OVER (ORDER BY sum(o_totalprice) DESC)::BIGINT AS rank
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY rank LIMIT 10
"""

query("match_group_sort", "lineitem", [{"$match": {"l_quantity": {"$gte": 25}}}, {"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}, "qty": {"$sum": "$l_quantity"}, "avg_price": {"$avg": "$l_extendedprice"}, "lo": {"$min": "$l_discount"}, "hi": {"$max": "$l_tax"}}}, {"$sort": {"_id": 1}}],
      "SELECT l_returnflag AS _id, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS avg_price, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_quantity >= 25 GROUP BY 1", rounded("qty", "avg_price"))

query("match_operators", "orders", [{"$match": {"o_orderstatus": {"$in": ["F", "O"]}, "o_totalprice": {"$gt": 1000, "$lte": 200000}, "o_orderpriority": {"$ne": "1-URGENT"}, "$expr": {"$lt": ["$o_custkey", "$o_orderkey"]}}}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}],
      "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderpriority <> '1-URGENT' AND o_custkey < o_orderkey")

query("project_computed", "lineitem", [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "net": {"$round": [{"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, 2]}, "ratio": {"$divide": ["$l_quantity", 4]}, "left": {"$mod": ["$l_partkey", 7]}, "big": {"$gt": ["$l_quantity", 30]}, "grade": {"$switch": {"branches": [{"case": {"$lt": ["$l_quantity", 10]}, "then": "small"}, {"case": {"$lt": ["$l_quantity", 30]}, "then": "mid"}], "default": "large"}}}}],
      "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS net, l_quantity / 4 AS ratio, (l_partkey % 7)::DOUBLE AS left, l_quantity > 30 AS big, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'mid' ELSE 'large' END AS grade FROM lineitem")

query("add_fields_unset", "part", [{"$addFields": {"price2": {"$add": ["$p_retailprice", 1]}, "info.size": "$p_size"}}, {"$set": {"s": "$info.size"}}, {"$unset": ["p_name", "info", "p_type"]}],
      "SELECT p_partkey, p_brand, p_size, p_retailprice, p_retailprice + 1 AS price2, p_size AS s FROM part")

query("sort_skip_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 5}, {"$limit": 20}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}],
      "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")

query("count_stage", "orders", [{"$match": {"o_totalprice": {"$gt": 100000}}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")

query("sort_by_count", "events", [{"$sortByCount": "$event_type"}], "SELECT event_type AS _id, count(*) AS count FROM events GROUP BY 1")

query("group_compound", "lineitem", [{"$group": {"_id": {"f": "$l_returnflag", "s": "$l_linestatus"}, "n": {"$sum": 1}}}, {"$project": {"flag": "$_id.f", "status": "$_id.s", "n": 1}}],
      "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")

query("group_first_last_push", "conversations", [{"$sort": {"conv_id": 1, "turn": 1}}, {"$group": {"_id": "$conv_id", "first": {"$first": "$role"}, "last": {"$last": "$turn"}, "roles": {"$push": "$role"}}}, {"$project": {"_id": 1, "first": 1, "last": 1, "n": {"$size": "$roles"}, "said": {"$reduce": {"input": "$roles", "initialValue": "", "in": {"$concat": ["$$value", "/", "$$this"]}}}}}],
      "SELECT conv_id AS _id, arg_min(role, turn) AS first, max(turn) AS last, count(*) AS n, '/' || string_agg(role, '/' ORDER BY turn) AS said FROM conversations GROUP BY 1")

query("group_add_to_set", "orders", [{"$group": {"_id": "$o_custkey", "statuses": {"$addToSet": "$o_orderstatus"}}}, {"$project": {"_id": 1, "n": {"$size": "$statuses"}}}],
      "SELECT o_custkey AS _id, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1")

query("lookup_equality", "nation", [{"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "s"}}, {"$project": {"n_name": 1, "n": {"$size": "$s"}, "first": {"$arrayElemAt": ["$s.s_name", 0]}, "names": {"$map": {"input": "$s", "as": "x", "in": "$$x.s_name"}}}}, {"$project": {"n_name": 1, "n": 1, "head": {"$first": "$names"}}}],
      "SELECT n_name, count(s_suppkey) AS n, arg_min(s_name, s_suppkey) AS head FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name")

query("lookup_unwind_join", "customer", [{"$match": {"c_acctbal": {"$gt": 5000}}}, {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "o_orderkey": "$o.o_orderkey"}}],
      "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000")

#: The two costliest chains, from every customer and every part.
TOP_ORDERS = [{"$lookup": {"from": "orders", "let": {"c": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$c"]}}}, {"$sort": {"o_totalprice": -1}}, {"$limit": 2}, {"$project": {"o_totalprice": 1}}], "as": "top"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$top"}, "best": {"$let": {"vars": {"t": {"$first": "$top"}}, "in": "$$t.o_totalprice"}}}}]
WALK = [{"$project": {"p_partkey": 1, "half": {"$toLong": {"$floor": {"$divide": ["$p_partkey", 2]}}}}}, {"$lookup": {"from": "nation", "localField": "half", "foreignField": "n_nationkey", "as": "x"}}, {"$graphLookup": {"from": "nation", "startWith": "$half", "connectFromField": "n_regionkey", "connectToField": "n_nationkey", "as": "walk", "depthField": "d"}}, {"$project": {"p_partkey": 1, "n": {"$size": "$walk"}, "deepest": {"$reduce": {"input": "$walk", "initialValue": -1, "in": {"$cond": [{"$gt": ["$$this.d", "$$value"]}, "$$this.d", "$$value"]}}}}}]

query("lookup_pipeline", "customer", TOP_ORDERS,
      "SELECT c_custkey, least(count(o_orderkey), 2) AS n, max(o_totalprice) AS best FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")

query("graph_lookup", "part", WALK,
      """WITH RECURSIVE s AS (SELECT p_partkey, p_partkey // 2 AS v FROM part),
w(p_partkey, k, nx, d, seen) AS (
  SELECT p_partkey, n_nationkey, n_regionkey, 0, [n_nationkey] FROM s JOIN nation ON n_nationkey = v
  UNION ALL SELECT p_partkey, n.n_nationkey, n.n_regionkey, d + 1, list_append(seen, n.n_nationkey) FROM w JOIN nation n ON n.n_nationkey = w.nx AND NOT list_contains(seen, n.n_nationkey))
SELECT s.p_partkey, count(k) AS n, coalesce(max(d), -1)::BIGINT AS deepest FROM s LEFT JOIN w USING (p_partkey) GROUP BY 1""")  # fmt: skip

query("union_with", "supplier", [{"$project": {"name": "$s_name", "bal": "$s_acctbal"}}, {"$unionWith": {"coll": "customer", "pipeline": [{"$match": {"c_acctbal": {"$lt": 0}}}, {"$project": {"name": "$c_name", "bal": "$c_acctbal"}}]}}],
      "SELECT s_name AS name, s_acctbal AS bal FROM supplier UNION ALL SELECT c_name, c_acctbal FROM customer WHERE c_acctbal < 0")

query("facet", "orders", [{"$facet": {"top": [{"$sort": {"o_totalprice": -1}}, {"$limit": 3}, {"$project": {"o_orderkey": 1}}], "all": [{"$count": "n"}]}}, {"$project": {"n": {"$let": {"vars": {"a": {"$first": "$all"}}, "in": "$$a.n"}}, "best": {"$let": {"vars": {"a": {"$first": "$top"}}, "in": "$$a.o_orderkey"}}, "tops": {"$size": "$top"}}}],
      "SELECT count(*) AS n, arg_max(o_orderkey, o_totalprice) AS best, 3::BIGINT AS tops FROM orders")

query("bucket_auto", "part", [{"$bucketAuto": {"groupBy": "$p_retailprice", "buckets": 7}}, {"$project": {"lo": "$_id.min", "hi": "$_id.max", "count": 1}}],
      "SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(*) AS count FROM (SELECT p_retailprice, ntile(7) OVER (ORDER BY p_retailprice, p_partkey) AS b FROM part) GROUP BY b")

query("window_fields", "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderdate": 1}, "output": {"num": {"$documentNumber": {}}, "rank": {"$rank": {}}, "dense": {"$denseRank": {}}, "prev": {"$shift": {"output": "$o_orderkey", "by": -1, "default": 0}}, "avg": {"$avg": "$o_totalprice", "window": {"documents": ["unbounded", "current"]}}}}}, {"$project": {"o_orderkey": 1, "num": 1, "rank": 1, "dense": 1, "prev": 1, "avg": {"$round": ["$avg", 1]}}}],
      """SELECT o_orderkey, row_number() OVER w AS num, rank() OVER r AS rank, dense_rank() OVER r AS dense, coalesce(lag(o_orderkey) OVER w, 0) AS prev,
floor(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) * 10 + 0.5) / 10 AS avg
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), r AS (PARTITION BY o_custkey ORDER BY o_orderdate)""")  # fmt: skip

query("unwind_split", "part", [{"$project": {"p_partkey": 1, "w": {"$split": ["$p_name", " "]}}}, {"$unwind": "$w"}, {"$group": {"_id": "$w", "n": {"$sum": 1}}}],
      "SELECT w AS _id, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")

query("replace_root", "orders", [{"$replaceRoot": {"newRoot": {"$mergeObjects": [{"$let": {"vars": {"r": "$$ROOT"}, "in": "$$r"}}]}}}, {"$project": {"o_orderkey": 1, "o_orderstatus": 1}}],
      "SELECT o_orderkey, o_orderstatus FROM orders")

query("dates", "orders", [{"$project": {"o_orderkey": 1, "y": {"$year": "$o_orderdate"}, "m": {"$month": "$o_orderdate"}, "dow": {"$dayOfWeek": "$o_orderdate"}, "doy": {"$dayOfYear": "$o_orderdate"}, "iso": {"$isoWeek": "$o_orderdate"}, "text": {"$dateToString": {"date": "$o_orderdate", "format": "%Y-%m-%d"}}, "next": {"$dateToString": {"date": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "day", "amount": 10}}, "format": "%Y%m%d"}}, "trunc": {"$dateToString": {"date": {"$dateTrunc": {"date": "$o_orderdate", "unit": "month"}}, "format": "%Y-%m-%d"}}, "days": {"$dateDiff": {"startDate": {"$toDate": "1992-01-01"}, "endDate": "$o_orderdate", "unit": "day"}}}}],
      """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofweek(o_orderdate) + 1 AS dow, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS iso, strftime(o_orderdate, '%Y-%m-%d') AS text,
strftime(o_orderdate + INTERVAL 10 DAY, '%Y%m%d') AS next, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS trunc, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days FROM orders""")  # fmt: skip

query("date_buckets", "events", [{"$group": {"_id": {"$dateTrunc": {"date": "$ts", "unit": "hour", "binSize": 6}}, "n": {"$sum": 1}}}, {"$project": {"bin": {"$dateToString": {"date": "$_id", "format": "%Y-%m-%d %H"}}, "n": 1}}],
      "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H') AS bin, count(*) AS n FROM events GROUP BY 1")

query("strings", "customer", [{"$project": {"c_custkey": 1, "up": {"$toUpper": "$c_mktsegment"}, "low": {"$toLower": "$c_name"}, "part": {"$substrCP": ["$c_name", 0, 5]}, "len": {"$strLenCP": "$c_name"}, "at": {"$indexOfCP": ["$c_name", "0"]}, "sub": {"$replaceAll": {"input": "$c_name", "find": "0", "replacement": "o"}}, "both": {"$concat": ["$c_mktsegment", "-", "$c_name"]}, "hit": {"$regexMatch": {"input": "$c_mktsegment", "regex": "^[A-M]"}}, "trim": {"$trim": {"input": {"$concat": [" ", "$c_name", " "]}}}}}],
      """SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, substr(c_name, 1, 5) AS part, length(c_name) AS len, instr(c_name, '0') - 1 AS at, replace(c_name, '0', 'o') AS sub, c_mktsegment || '-' || c_name AS both,
regexp_matches(c_mktsegment, '^[A-M]') AS hit, c_name AS trim FROM customer""")  # fmt: skip

query("array_functions", "embeddings", [{"$project": {"vec_id": 1, "head": {"$slice": ["$embedding", 3]}, "pos": {"$filter": {"input": "$embedding", "as": "x", "cond": {"$gt": ["$$x", 0]}}}, "last": {"$last": "$embedding"}, "any": {"$anyElementTrue": "$embedding"}}}, {"$project": {"vec_id": 1, "n": {"$size": "$head"}, "pos": {"$size": "$pos"}, "last": {"$toDouble": "$last"}, "any": 1}}],
      "SELECT vec_id, least(len(embedding), 3) AS n, len(list_filter(embedding, lambda x: x > 0)) AS pos, embedding[-1]::DOUBLE AS last, len(list_filter(embedding, lambda x: x <> 0)) > 0 AS any FROM embeddings")

query("set_functions", "orders", [{"$group": {"_id": "$o_custkey", "s": {"$addToSet": "$o_orderstatus"}, "p": {"$addToSet": "$o_orderpriority"}}}, {"$project": {"_id": 1, "u": {"$size": {"$setUnion": ["$s", "$p"]}}, "i": {"$size": {"$setIntersection": ["$s", {"$literal": ["F", "O"]}]}}, "sub": {"$setIsSubset": [{"$literal": ["F"]}, "$s"]}, "has": {"$in": ["P", "$s"]}}}],
      "SELECT o_custkey AS _id, count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority) AS u, count(DISTINCT o_orderstatus) FILTER (o_orderstatus IN ('F', 'O')) AS i, bool_or(o_orderstatus = 'F') AS sub, bool_or(o_orderstatus = 'P') AS has FROM orders GROUP BY 1")

query("conversions", "events", [{"$project": {"event_id": 1, "whole": {"$toInt": "$value"}, "text": {"$toString": "$user_id"}, "flag": {"$toBool": "$value"}, "kind": {"$type": "$props"}, "safe": {"$convert": {"input": "$event_type", "to": "int", "onError": -1}}, "either": {"$ifNull": ["$nope", "$event_type"]}}}],
      "SELECT event_id, trunc(value)::BIGINT AS whole, user_id::VARCHAR AS text, value <> 0 AS flag, 'string' AS kind, -1::BIGINT AS safe, event_type AS either FROM events")

query("arithmetic", "part", [{"$project": {"p_partkey": 1, "a": {"$abs": {"$subtract": ["$p_size", 25]}}, "c": {"$ceil": "$p_retailprice"}, "f": {"$floor": "$p_retailprice"}, "s": {"$round": [{"$sqrt": "$p_size"}, 4]}, "p": {"$pow": ["$p_size", 2]}, "t": {"$trunc": ["$p_retailprice", 1]}, "l": {"$round": [{"$ln": "$p_size"}, 4]}, "cmp": {"$cmp": ["$p_size", 25]}}}],
      "SELECT p_partkey, abs(p_size - 25)::DOUBLE AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, floor(sqrt(p_size) * 10000 + 0.5) / 10000 AS s, (p_size * p_size)::DOUBLE AS p, floor(p_retailprice * 10) / 10 AS t, floor(ln(p_size) * 10000 + 0.5) / 10000 AS l, sign(p_size - 25)::BIGINT AS cmp FROM part")

QUERY_VECTOR = [round(((k * 37) % 64 - 32) / 32, 4) for k in range(64)]
query("vector_search", "embeddings", [{"$match": {"label": {"$lt": 8}}}, {"$vectorSearch": {"path": "embedding", "queryVector": QUERY_VECTOR, "limit": 15}}, {"$project": {"vec_id": 1, "score": {"$round": [{"$meta": "vectorSearchScore"}, 6]}}}],
      f"""SELECT vec_id, sign(s) * floor(abs(s) * 1000000 + 0.5) / 1000000 AS score FROM (
SELECT vec_id, list_sum(list_transform(list_zip(embedding, {QUERY_VECTOR}::DOUBLE[]), lambda p: p[1]::DOUBLE * p[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({QUERY_VECTOR}::DOUBLE[], lambda x: x * x)))) AS s
FROM embeddings WHERE label < 8) ORDER BY s DESC, vec_id LIMIT 15""")  # fmt: skip

query("coll_stats", "orders", [{"$collStats": {"storageStats": {}}}, {"$project": {"n": "$storageStats.count"}}], "SELECT 0::BIGINT AS n")

query("sample", "orders", [{"$sample": {"size": 25}}, {"$count": "n"}], "SELECT 25::BIGINT AS n")


def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find with filter, sort, skip and limit."""
    return Tables(spark, sf_dir).collection("supplier").find({"s_acctbal": {"$gte": 0}}, sort={"s_acctbal": -1, "s_suppkey": 1}, skip=2, limit=10)


QUERIES["find"] = find
ORACLES["find"] = "SELECT * FROM supplier WHERE s_acctbal >= 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 10 OFFSET 2"


def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(Tables(spark, sf_dir).collection("lineitem").count({"l_returnflag": "R"}),)], "n long")


QUERIES["count"] = count
ORACLES["count"] = "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'"


def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators on the rows of one segment, then what the collection holds."""
    c = Tables(spark, sf_dir).collection("customer")
    c.update({"c_mktsegment": "BUILDING"}, {"$inc": {"c_acctbal": 100, "visits": 1}, "$set": {"note.by": "x"}, "$push": {"tags": "seen"}}, multi=True)
    return c.aggregate([{"$project": {"c_custkey": 1, "bal": {"$round": ["$c_acctbal", 2]}, "visits": 1, "by": "$note.by", "n": {"$size": "$tags"}}}])


QUERIES["update"] = update
ORACLES["update"] = """
SELECT c_custkey, sign(b) * floor(abs(b) * 100 + 0.5) / 100 AS bal, CASE WHEN hit THEN 1 END::BIGINT AS visits, CASE WHEN hit THEN 'x' END AS by, CASE WHEN hit THEN 1 ELSE 0 END::BIGINT AS n
FROM (SELECT *, c_mktsegment = 'BUILDING' AS hit, c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 100 ELSE 0 END AS b FROM customer)
"""


def insert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added from another table, rows taken out."""
    tables = Tables(spark, sf_dir)
    c = tables.collection("region")
    c.insert_frame(tables.frame("nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")))
    c.delete({"r_regionkey": {"$lt": 3}})
    return c.find()


QUERIES["insert_delete"] = insert_delete
ORACLES["insert_delete"] = "SELECT * FROM (SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation) WHERE r_regionkey >= 3"


# --- the rest of the expressions -------------------------------------------------------------------

query("logic", "part", [{"$project": {"p_partkey": 1, "both": {"$and": [{"$gt": ["$p_size", 10]}, {"$lt": ["$p_size", 40]}]}, "any": {"$or": [{"$lt": ["$p_size", 5]}, {"$gt": ["$p_retailprice", 1500]}]}, "no": {"$not": [{"$gt": ["$p_size", 25]}]}, "e": {"$round": [{"$exp": {"$divide": ["$p_size", 10]}}, 4]}, "ten": {"$round": [{"$log10": "$p_size"}, 4]}, "two": {"$round": [{"$log": ["$p_size", 2]}, 4]}, "rand": {"$let": {"vars": {"x": {"$rand": {}}}, "in": {"$and": [{"$gte": ["$$x", 0]}, {"$lt": ["$$x", 1]}]}}}}}],
      "SELECT p_partkey, p_size > 10 AND p_size < 40 AS both, p_size < 5 OR p_retailprice > 1500 AS any, p_size <= 25 AS no, floor(exp(p_size / 10) * 10000 + 0.5) / 10000 AS e, floor(log10(p_size) * 10000 + 0.5) / 10000 AS ten, floor(log2(p_size) * 10000 + 0.5) / 10000 AS two, true AS rand FROM part")

query("strings_more", "customer", [{"$project": {"c_custkey": 1, "sub": {"$substr": ["$c_name", 2, 4]}, "bytes": {"$substrBytes": ["$c_name", 0, 8]}, "len": {"$strLenBytes": "$c_name"}, "at": {"$indexOfBytes": ["$c_name", "#"]}, "first": {"$regexFind": {"input": "$c_name", "regex": "[1-9][0-9]*"}}, "zeros": {"$regexFindAll": {"input": "$c_name", "regex": "0"}}, "order": {"$strcasecmp": ["$c_mktsegment", "furniture"]}, "one": {"$replaceOne": {"input": "$c_name", "find": "0", "replacement": "o"}}, "left": {"$ltrim": {"input": {"$concat": ["  ", "$c_name", " "]}}}, "right": {"$rtrim": {"input": "$c_name", "chars": "0123456789"}}}}, {"$addFields": {"first": "$first.match", "idx": "$first.idx", "zeros": {"$size": "$zeros"}}}],
      """SELECT c_custkey, substr(c_name, 3, 4) AS sub, substr(c_name, 1, 8) AS bytes, strlen(c_name) AS len, instr(c_name, '#') - 1 AS at, nullif(regexp_extract(c_name, '[1-9][0-9]*'), '') AS first, len(regexp_extract_all(c_name, '0')) AS zeros,
CASE WHEN lower(c_mktsegment) = 'furniture' THEN 0 WHEN lower(c_mktsegment) < 'furniture' THEN -1 ELSE 1 END::BIGINT AS order, regexp_replace(c_name, '0', 'o') AS one, c_name || ' ' AS left, rtrim(c_name, '0123456789') AS right, instr(c_name, nullif(regexp_extract(c_name, '[1-9][0-9]*'), '')) - 1 AS idx FROM customer""")  # fmt: skip

query("arrays_more", "embeddings", [{"$project": {"vec_id": 1, "least": {"$toDouble": {"$first": {"$sortArray": {"input": "$embedding", "sortBy": 1}}}}, "most": {"$toDouble": {"$first": {"$sortArray": {"input": "$embedding", "sortBy": -1}}}}, "tail": {"$toDouble": {"$first": {"$reverseArray": "$embedding"}}}, "twice": {"$size": {"$concatArrays": ["$embedding", "$embedding"]}}, "steps": {"$size": {"$range": [0, {"$mod": ["$vec_id", 7]}, 2]}}, "pairs": {"$size": {"$zip": {"inputs": ["$embedding", {"$literal": [1, 2]}]}}}, "place": {"$indexOfArray": ["$embedding", {"$last": "$embedding"}]}, "is": {"$isArray": "$embedding"}, "isnt": {"$isArray": "$label"}, "all": {"$allElementsTrue": "$embedding"}}}],
      "SELECT vec_id, list_min(embedding)::DOUBLE AS least, list_max(embedding)::DOUBLE AS most, embedding[-1]::DOUBLE AS tail, 2 * len(embedding) AS twice, (vec_id % 7 + 1) // 2 AS steps, 2::BIGINT AS pairs, (list_position(embedding, embedding[-1]) - 1)::BIGINT AS place, true AS is, false AS isnt, len(list_filter(embedding, lambda x: x = 0)) = 0 AS all FROM embeddings")

query("objects", "events", [{"$project": {"event_id": 1, "user_id": 1}}, {"$addFields": {"o.a": "$event_id", "o.b": "$user_id"}}, {"$project": {"event_id": 1, "a": {"$getField": {"field": "a", "input": "$o"}}, "c": {"$getField": {"field": "c", "input": {"$setField": {"field": "c", "input": "$o", "value": "$o.b"}}}}, "k": {"$map": {"input": {"$objectToArray": {"$unsetField": {"field": "b", "input": "$o"}}}, "as": "e", "in": "$$e.k"}}, "last": {"$getField": {"field": "x", "input": {"$arrayToObject": {"$literal": [{"k": "x", "v": 1}, {"k": "x", "v": 2}]}}}}}}, {"$addFields": {"k": {"$first": "$k"}, "n": {"$size": "$k"}}}],
      "SELECT event_id, event_id AS a, user_id AS c, 'a' AS k, 2::BIGINT AS last, 1::BIGINT AS n FROM events")

_JOINED = {"$reduce": {"input": {"$sortArray": {"input": {"$setUnion": ["$s", "$p"]}, "sortBy": 1}}, "initialValue": "", "in": {"$concat": ["$$value", "|", "$$this"]}}}
query("sets_more", "orders", [{"$group": {"_id": "$o_custkey", "s": {"$addToSet": "$o_orderstatus"}, "p": {"$addToSet": "$o_orderpriority"}}}, {"$project": {"_id": 1, "all": _JOINED, "rest": {"$size": {"$setDifference": ["$s", {"$literal": ["F"]}]}}, "full": {"$setEquals": ["$s", {"$literal": ["P", "O", "F", "F"]}]}}}],
      "SELECT o_custkey AS _id, (SELECT '|' || string_agg(v, '|' ORDER BY v) FROM (SELECT unnest(list_distinct(list_concat(s, p))) AS v)) AS all, len(list_filter(s, lambda x: x <> 'F')) AS rest, len(s) = 3 AS full FROM (SELECT o_custkey, list_distinct(list(o_orderstatus)) AS s, list_distinct(list(o_orderpriority)) AS p FROM orders GROUP BY 1)")

query("dates_more", "events", [{"$project": {"event_id": 1, "day": {"$dayOfMonth": "$ts"}, "h": {"$hour": "$ts"}, "mi": {"$minute": "$ts"}, "s": {"$second": "$ts"}, "ms": {"$millisecond": "$ts"}, "week": {"$week": "$ts"}, "iso_year": {"$isoWeekYear": "$ts"}, "iso_day": {"$isoDayOfWeek": "$ts"}, "before": {"$dateToString": {"date": {"$dateSubtract": {"startDate": "$ts", "unit": "hour", "amount": 36}}, "format": "%Y-%m-%dT%H:%M:%S"}}, "parts": {"$dateToParts": {"date": "$ts"}}, "first": {"$dateToString": {"date": {"$dateFromParts": {"year": {"$year": "$ts"}, "month": {"$month": "$ts"}, "day": 1}}, "format": "%Y-%m-%d"}}, "back": {"$dateToString": {"date": {"$dateFromString": {"dateString": {"$dateToString": {"date": "$ts", "format": "%d.%m.%Y"}}, "format": "%d.%m.%Y"}}, "format": "%Y%m%d"}}, "months": {"$dateDiff": {"startDate": {"$toDate": "1990-01-01"}, "endDate": "$ts", "unit": "month"}}}}, {"$addFields": {"parts": "$parts.minute"}}],
      """SELECT event_id, day(ts) AS day, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, millisecond(ts) % 1000 AS ms, strftime(ts, '%U')::BIGINT AS week, isoyear(ts) AS iso_year, isodow(ts) AS iso_day, strftime(ts - INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%S') AS before, minute(ts) AS parts,
strftime(date_trunc('month', ts), '%Y-%m-%d') AS first, strftime(ts, '%Y%m%d') AS back, date_sub('month', TIMESTAMP '1990-01-01', ts) AS months FROM events""")  # fmt: skip

# --- the rest of the stages and filters -----------------------------------------------------------

WORDS = ["small", "ring", "gear"]
query("match_array_dotted", "part", [{"$addFields": {"o.size": "$p_size", "o.deep.price": "$p_retailprice", "words": {"$split": ["$p_name", " "]}}}, {"$match": {"o.size": {"$gt": 10, "$ne": 20}, "o.deep.price": {"$lt": 1500}, "p_size": {"$in": list(range(1, 45))}, "words": {"$in": WORDS}}}, {"$project": {"p_partkey": 1, "o.size": 1}}, {"$project": {"p_partkey": 1, "size": "$o.size"}}],
      f"SELECT p_partkey, p_size AS size FROM part WHERE p_size > 10 AND p_size <> 20 AND p_retailprice < 1500 AND p_size < 45 AND list_has_any(string_split(p_name, ' '), {WORDS})")

query("lookup_array", "nation", [{"$project": {"n_nationkey": 1, "keys": {"$range": [0, {"$mod": ["$n_nationkey", 7]}]}}}, {"$lookup": {"from": "region", "localField": "keys", "foreignField": "r_regionkey", "as": "r"}}, {"$project": {"n_nationkey": 1, "n": {"$size": "$r"}, "names": {"$reduce": {"input": "$r", "initialValue": "", "in": {"$concat": ["$$value", "$$this.r_name", ";"]}}}}}],
      "SELECT n_nationkey, count(r_regionkey) AS n, coalesce(string_agg(r_name || ';', '' ORDER BY r_regionkey), '') AS names FROM nation LEFT JOIN region ON r_regionkey < n_nationkey % 7 GROUP BY 1")

query("replace_with", "orders", [{"$project": {"o_orderkey": 1, "o_orderstatus": 1}}, {"$replaceWith": {"$mergeObjects": ["$$ROOT", {"o_orderstatus": "none", "n": 1}]}}],
      "SELECT o_orderkey, 'none' AS o_orderstatus, 1::BIGINT AS n FROM orders")

for _name, _kind, _score in (
    ("vector_search_dot", "dotProduct", "list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]))"),
    ("vector_search_euclidean", "euclidean", "1 / (1 + sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))))"),
):
    query(_name, "embeddings", [{"$vectorSearch": {"path": "embedding", "queryVector": QUERY_VECTOR, "limit": 12, "similarity": _kind}}, {"$project": {"vec_id": 1, "score": {"$round": [{"$meta": "vectorSearchScore"}, 6]}}}],
          f"SELECT vec_id, sign(s) * floor(abs(s) * 1000000 + 0.5) / 1000000 AS score FROM (SELECT vec_id, {_score} AS s FROM (SELECT *, {QUERY_VECTOR}::DOUBLE[] AS q FROM embeddings)) ORDER BY s DESC, vec_id LIMIT 12")


# --- writes, catalogue, streams ---------------------------------------------------------------------


def update_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacement, $unset, $addToSet, $push on a scalar, first match only and an upsert."""
    c = Tables(spark, sf_dir).collection("nation")
    c.update({"n_nationkey": 0}, {"n_nationkey": 0, "n_name": "ZERO"})
    c.update({"n_nationkey": {"$in": [1, 2]}}, {"$unset": {"n_name": ""}}, multi=True)
    for tag in ("a", "b", "a"):
        c.update({"n_regionkey": 3}, {"$addToSet": {"tags": tag}}, multi=True)
    c.update({"n_regionkey": 2}, {"$set": {"n_name": "FIRST"}})
    c.update({"n_nationkey": 900, "n_name": "NEW"}, {"$inc": {"n_regionkey": 7}, "$push": {"tags": "x"}}, upsert=True)
    return c.aggregate([{"$project": {"n_nationkey": 1, "n_name": 1, "n_regionkey": 1, "n": {"$size": "$tags"}}}])


QUERIES["update_kinds"] = update_kinds
ORACLES["update_kinds"] = """
SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'ZERO' WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2 AND n_nationkey <> 0) THEN 'FIRST' WHEN n_nationkey IN (1, 2) THEN NULL ELSE n_name END AS n_name,
       CASE WHEN n_nationkey <> 0 THEN n_regionkey END::BIGINT AS n_regionkey, CASE WHEN n_regionkey = 3 AND n_nationkey <> 0 THEN 2 ELSE 0 END::BIGINT AS n
FROM nation UNION ALL SELECT 900, 'NEW', 7, 1
"""


def raises(kind: type[Exception], f, *args) -> int:
    try:
        f(*args)
    except kind:
        return 1
    return 0


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases, collections, statistics, indexes and what is refused: (what, n)."""
    tables = Tables(spark, sf_dir)
    engine = Engine(spark)
    c = engine.register("shop.nation", tables.frame("nation"), "n_nationkey")
    engine.register("shop.region", tables.frame("region"))
    engine.create("other.new")
    name = c.create_index(["n_nationkey"], unique=True)
    out = [("databases", len(engine.list_databases())), ("collections", len(engine.list_collections("shop"))), ("count", c.stats()["count"]), ("objects", engine.stats("shop")["objects"]), ("indexes", len(c.list_indexes()))]
    out += [("duplicates refused", raises(DuplicateKey, c.create_index, ["n_regionkey"]) + raises(DuplicateKey, lambda: c.create_index(["n_regionkey"], unique=True)) + raises(DuplicateKey, c.insert, [{"n_nationkey": 3}]))]
    c.drop_index(name)
    c.insert([{"n_nationkey": 3}])
    out += [("after insert", c.count({"n_nationkey": 3})), ("dropped", int(engine.drop("other.new")) + engine.drop_database("shop")), ("left", len(engine.list_collections()))]
    part = tables.collection("part")
    wrong = [{"$match": {"p_size": {"$regex": "x"}}}, {"$out": "x"}, {"$group": {"_id": None, "x": {"$stdDevPop": "$p_size"}}}, {"$project": {"x": {"$toHashedIndexKey": 1}}}]
    out += [("refused", sum(raises(UnsupportedOperator, part.aggregate, [w]) for w in wrong) + raises(UnsupportedOperator, part.update, {}, {"$rename": {"p_name": "n"}}))]
    return spark.createDataFrame(out, "what string, n long")


QUERIES["catalogue"] = catalogue
ORACLES["catalogue"] = """
SELECT * FROM (VALUES ('databases', 2::BIGINT), ('collections', 2), ('indexes', 1), ('duplicates refused', 2), ('dropped', 3), ('left', 0), ('refused', 5))  t(what, n)
UNION ALL SELECT 'count', count(*) FROM nation UNION ALL SELECT 'objects', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) UNION ALL SELECT 'after insert', count(*) + 1 FROM nation WHERE n_nationkey = 3
"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateless stages over ``readStream``, run to the end of what there is."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    out = compile_stream(rows, [{"$match": {"o_totalprice": {"$gt": 150000}}}, {"$addFields": {"year": {"$year": "$o_orderdate"}, "tags": {"$split": ["$o_orderpriority", "-"]}}}, {"$unwind": "$tags"}, {"$project": {"o_orderkey": 1, "year": 1, "tags": 1}}])
    target = new_path(spark, "stream")
    out.writeStream.format("parquet").option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(out.schema).parquet(target)


QUERIES["stream"] = stream
ORACLES["stream"] = "SELECT o_orderkey, year(o_orderdate) AS year, unnest(string_split(o_orderpriority, '-')) AS tags FROM orders WHERE o_totalprice > 150000"
