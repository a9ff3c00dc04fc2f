"""Stage fixtures, each with its expected rows."""

import datetime as dt

import pytest

from docloom import BadSpec, Engine, UnsupportedOperator, compile_pipeline

UTC = dt.datetime


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def run(spark, data, ddl, pipeline, **tables):
    engine = Engine(spark)
    for name, (d, s) in tables.items():
        engine.register(name, spark.createDataFrame(d, s))
    return rows(compile_pipeline(spark.createDataFrame(data, ddl), pipeline, engine, "_id" if "_id" in ddl else None))


def test_match_group_sort_limit(spark):
    got = run(spark, [(25, 10.0), (25, 30.0), (30, 50.0)], "age int, score double", [{"$match": {"age": {"$gt": 20}}}, {"$group": {"_id": "$age", "avg": {"$avg": "$score"}, "n": {"$sum": 1}}}, {"$sort": {"avg": -1}}, {"$limit": 1}])
    assert got == [{"_id": 30, "avg": 50.0, "n": 1}]


def test_size_modes(spark):
    data = [(1, [1, 2, 3]), (2, [1, 2]), (3, None)]
    assert [r["n"] for r in run(spark, data, "_id int, users array<int>", [{"$project": {"n": {"$size": "$users"}}}])] == [3, 2, 0]
    assert [r["n"] for r in run(spark, data, "_id int, users array<int>", [{"$addFields": {"n": {"$size": "$users"}}}])] == [3, 2, None]
    assert [r["n"] for r in run(spark, [(1, "no")], "_id int, users string", [{"$project": {"n": {"$size": "$users"}}}])] == [0]


def test_unset_and_nested_set(spark):
    assert run(spark, [(1, 1, (2, 3))], "_id int, a int, nested struct<b:int,c:int>", [{"$unset": ["a", "_id", "nested.b"]}]) == [{"nested": {"c": 3}}]
    got = run(spark, [(1, ("NY",)), (2, None)], "_id int, address struct<city:string>", [{"$addFields": {"cityCopy": "$address.city", "address.city": "LA"}}])
    assert [(r["cityCopy"], r["address"]["city"]) for r in got] == [("NY", "LA"), (None, "LA")]


def test_count_of_nothing_and_group_of_nothing(spark):
    assert run(spark, [], "a int", [{"$count": "n"}]) == [{"n": 0}]
    assert run(spark, [], "a int", [{"$group": {"_id": None, "n": {"$sum": 1}}}]) == []


def test_lookup_equality_null_and_arrays(spark):
    got = run(spark, [(1, ("NY",)), (2, None)], "_id int, address struct<city:string>", [{"$lookup": {"from": "f", "localField": "address.city", "foreignField": "city", "as": "m"}}, {"$sort": {"_id": 1}}], f=([("nyc", "NY"), ("none", None)], "name string, city string"))
    assert [[m["name"] for m in r["m"]] for r in got] == [["nyc"], ["none"]]
    got = run(spark, [(1, ["a", "b"]), (2, []), (3, None)], "_id int, tags array<string>", [{"$lookup": {"from": "f", "localField": "tags", "foreignField": "tag", "as": "m"}}, {"$sort": {"_id": 1}}], f=([("a", 1), ("c", 2), ("b", 3)], "tag string, v int"))
    assert [sorted(m["tag"] for m in r["m"]) for r in got] == [["a", "b"], [], []]
    got = run(spark, [(1, 5)], "_id int, k int", [{"$lookup": {"from": "f", "localField": "k", "foreignField": "ks", "as": "m"}}], f=([("x", [5, 5, 6]), ("y", [7])], "n string, ks array<int>"))
    assert [[m["n"] for m in r["m"]] for r in got] == [["x"]]


def test_lookup_then_unwind_is_a_join(spark):
    steps = [{"$lookup": {"from": "f", "localField": "k", "foreignField": "k", "as": "m"}}, {"$unwind": {"path": "$m", "preserveNullAndEmptyArrays": True}}, {"$sort": {"_id": 1, "m.v": 1}}]
    got = run(spark, [(1, 5), (2, 6)], "_id int, k int", steps, f=([(5, 1), (5, 2)], "k int, v int"))
    assert [(r["_id"], r["m"] and r["m"]["v"]) for r in got] == [(1, 1), (1, 2), (2, None)]


def test_lookup_pipeline_with_variables(spark):
    people = [("u1", 1, "Alice", None), ("u2", 2, "Bob", 1), ("u3", 3, "Cara", 1)]
    ddl = "_id string, user_id int, name string, manager_id int"
    step = {"$lookup": {"from": "users", "let": {"mgr_id": "$manager_id"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$user_id", "$$mgr_id"]}}}, {"$project": {"name": 1, "mgr": "$$mgr_id"}}], "as": "m"}}
    got = {r["name"]: r["m"] for r in run(spark, people, ddl, [step], users=(people, ddl))}
    assert got["Alice"] == [] and got["Bob"] == [{"name": "Alice", "mgr": 1}]


def test_lookup_pipeline_sorts_and_limits_within_a_row(spark):
    steps = [{"$lookup": {"from": "o", "let": {"c": "$_id"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$c", "$$c"]}}}, {"$sort": {"v": -1}}, {"$limit": 2}], "as": "top"}}, {"$sort": {"_id": 1}}]
    got = run(spark, [(1,), (2,)], "_id int", steps, o=([(1, 5), (1, 9), (1, 7), (2, 1)], "c int, v int"))
    assert [[t["v"] for t in r["top"]] for r in got] == [[9, 7], [1]]


def test_bucket_auto(spark):
    got = run(spark, [(k, k * 10) for k in range(1, 6)], "_id int, n int", [{"$bucketAuto": {"groupBy": "$n", "buckets": 3}}])
    assert sorted((r["_id"]["min"], r["_id"]["max"], r["count"]) for r in got) == [(10, 20, 2), (30, 40, 2), (50, 50, 1)]
    with pytest.raises(UnsupportedOperator):
        run(spark, [(1, 1)], "_id int, n int", [{"$bucketAuto": {"groupBy": "$n", "buckets": 3, "output": {}}}])


def test_unwind(spark):
    assert [r["orders"]["id"] for r in run(spark, [(1, [(10,), (11,)])], "_id int, orders array<struct<id:int>>", [{"$unwind": "$orders"}])] == [10, 11]
    data = [(1, None), (2, [])]
    keep = [{"$unwind": {"path": "$orders", "preserveNullAndEmptyArrays": True}}]
    assert [r["orders"] for r in run(spark, data, "_id int, orders array<int>", keep)] == [None, None]
    assert run(spark, data, "_id int, orders array<int>", [{"$unwind": "$orders"}]) == []
    assert [r["orders"]["items"] for r in run(spark, [(1, (["a", "b"],))], "_id int, orders struct<items:array<string>>", [{"$unwind": "$orders.items"}])] == ["a", "b"]
    assert run(spark, [(1, "x")], "_id int, orders string", [{"$unwind": "$orders"}]) == [{"_id": 1, "orders": "x"}]


def test_group_accumulators_keep_order_and_nulls(spark):
    got = run(spark, [(1, "a", None), (2, "a", 5), (3, "a", 5)], "_id int, k string, v int", [{"$sort": {"_id": -1}}, {"$group": {"_id": "$k", "first": {"$first": "$v"}, "last": {"$last": "$v"}, "all": {"$push": "$v"}, "set": {"$addToSet": "$v"}, "lo": {"$min": "$v"}, "sum": {"$sum": "$v"}}}])[0]
    assert (got["first"], got["last"], got["all"], got["lo"], got["sum"]) == (5, None, [5, 5, None], 5, 10)
    assert sorted(got["set"], key=str) == [5, None]


def test_compound_group_key_and_sort_by_count(spark):
    got = run(spark, [("x", 1), ("x", 1), ("y", 2)], "a string, b int", [{"$group": {"_id": {"a": "$a", "b": "$b"}, "n": {"$sum": 1}}}, {"$sort": {"n": -1}}])
    assert got[0] == {"_id": {"a": "x", "b": 1}, "n": 2}
    assert run(spark, [("x", 1), ("x", 1), ("y", 2)], "a string, b int", [{"$sortByCount": "$a"}])[0] == {"_id": "x", "count": 2}


def test_sample_facet_union_replace(spark):
    data = [(k,) for k in range(3)]
    assert [len(run(spark, data, "_id int", [{"$sample": {"size": n}}])) for n in (1, 0, 10)] == [1, 0, 3]
    got = run(spark, [(1, 10.0), (2, 50.0)], "_id int, salary double", [{"$facet": {"recent": [{"$sort": {"_id": -1}}, {"$limit": 1}], "top": [{"$group": {"_id": None, "m": {"$max": "$salary"}}}]}}])
    assert got[0]["recent"][0]["_id"] == 2 and got[0]["top"][0]["m"] == 50.0
    assert len(run(spark, data, "_id int", [{"$unionWith": {"coll": "o", "pipeline": [{"$match": {"_id": {"$gt": 5}}}]}}], o=([(4, "a"), (9, "b")], "_id int, s string"))) == 4
    assert run(spark, [(1, (2, 3))], "_id int, d struct<a:int,b:int>", [{"$replaceRoot": {"newRoot": "$d"}}]) == [{"a": 2, "b": 3}]
    with pytest.raises(BadSpec):
        run(spark, [(1, 2)], "_id int, d int", [{"$replaceWith": "$d"}])


def test_windows(spark):
    data = [(1, 30, 20.0), (2, 30, 10.0), (3, 30, 20.0), (4, 40, 5.0)]
    ddl = "_id int, age int, salary double"
    got = run(spark, data, ddl, [{"$setWindowFields": {"partitionBy": "$age", "sortBy": {"salary": 1}, "output": {"rank": {"$rank": {}}, "dense": {"$denseRank": {}}, "num": {"$documentNumber": {}}, "avg": {"$avg": "$salary", "window": {"documents": ["unbounded", "current"]}}, "prev": {"$shift": {"output": "$salary", "by": -1, "default": 0}}}}}, {"$sort": {"_id": 1}}])
    assert [r["rank"] for r in got] == [2, 1, 2, 1]
    assert [r["dense"] for r in got] == [2, 1, 2, 1]
    assert [r["num"] for r in got] == [2, 1, 3, 1]
    assert [round(r["avg"], 3) for r in got] == [15.0, 10.0, 16.667, 5.0]
    assert [r["prev"] for r in got] == [10.0, 0.0, 20.0, 0.0]


def test_graph_lookup(spark):
    people = [(1, None, "Alice", True), (2, 1, "Bob", True), (3, 2, "Cara", True), (4, 2, "Dan", False)]
    spec = {"from": "p", "startWith": "$manager_id", "connectFromField": "manager_id", "connectToField": "user_id", "as": "chain", "depthField": "depth"}
    one = lambda **more: run(spark, [(10, 3)], "_id int, manager_id int", [{"$graphLookup": {**spec, **more}}], p=(people, "user_id int, manager_id int, name string, active boolean"))[0]["chain"]
    assert [(c["user_id"], c["depth"]) for c in one()] == [(3, 0), (2, 1), (1, 2)]
    assert [c["user_id"] for c in one(maxDepth=1)] == [3, 2]
    assert one(restrictSearchWithMatch={"active": False}) == []
    cyclic = run(spark, [(1, 1)], "_id int, s int", [{"$graphLookup": {"from": "c", "startWith": "$s", "connectFromField": "b", "connectToField": "a", "as": "x"}}], c=([(1, 2), (2, 1)], "a int, b int"))
    assert [c["a"] for c in cyclic[0]["x"]] == [1, 2]


def test_vector_search(spark):
    data = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])]
    got = run(spark, data, "_id int, embedding array<double>", [{"$match": {"_id": {"$gt": 0}}}, {"$vectorSearch": {"path": "embedding", "queryVector": [1.0, 0.2], "limit": 2}}, {"$project": {"_id": 1, "score": {"$meta": "vectorSearchScore"}}}])
    assert [r["_id"] for r in got] == [1, 3] and got[0]["score"] > got[1]["score"]
    with pytest.raises(BadSpec):
        run(spark, data, "_id int, embedding array<double>", [{"$sort": {"_id": 1}}, {"$vectorSearch": {"path": "embedding", "queryVector": [1.0, 0.2]}}])


def test_projects_dotted_arrays(spark):
    got = run(spark, [(1, [(1, "a", True), (2, "b", False)])], "_id int, c array<struct<id:int,name:string,on:boolean>>", [{"$project": {"c.id": 1, "c.on": 1}}])
    assert got == [{"c": [{"id": 1, "on": True}, {"id": 2, "on": False}]}]


def test_filters(spark):
    data = [(1, 5, "a", [1, 2], True), (2, None, "b", None, False), (3, 7, None, [3], None)]
    ddl = "_id int, n int, s string, xs array<int>, b boolean"
    ids = lambda f: sorted(r["_id"] for r in run(spark, data, ddl, [{"$match": f}]))
    assert ids({"n": 5}) == [1] and ids({"n": 5.0}) == [1] and ids({"n": None}) == []
    assert ids({"n": {"$gte": 5, "$lt": 7}}) == [1] and ids({"s": {"$gt": 1}}) == []
    assert ids({"n": {"$ne": 5}}) == [3] and ids({"s": {"$in": ["a", "b"]}}) == [1, 2] and ids({"xs": {"$in": [2, 3]}}) == [1, 3]
    assert ids({"xs": [1, 2]}) == [1] and ids({"xs": 1}) == [] and ids({"b": True}) == [1]
    assert ids({"$expr": {"$gt": ["$n", 5]}}) == [2, 3]  # null lies above numbers
    for bad in ({"$or": []}, {"n": {"$exists": True}}):
        with pytest.raises(UnsupportedOperator):
            ids(bad)
    with pytest.raises(UnsupportedOperator):
        run(spark, data, ddl, [{"$merge": "x"}])


def test_sort_of_nulls_and_skip(spark):
    data = [(1, 5, "b"), (2, None, None), (3, 1, "a")]
    ids = lambda s: [r["_id"] for r in run(spark, data, "_id int, n int, s string", s)]
    assert ids([{"$sort": {"n": 1}}]) == [3, 1, 2] and ids([{"$sort": {"n": -1}}]) == [2, 1, 3]
    assert ids([{"$sort": {"s": 1}}]) == [2, 3, 1] and ids([{"$sort": {"s": -1}}, {"$skip": 1}, {"$limit": 1}]) == [3]


def test_streams_run_stateless_stages(spark, tmp_path):
    from docloom.streaming import compile_stream

    spark.createDataFrame([(1, 2), (2, 30)], "_id int, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("_id int, v int").parquet(str(tmp_path / "in"))
    out = compile_stream(stream, [{"$match": {"v": {"$gt": 5}}}, {"$addFields": {"w": {"$multiply": ["$v", 2]}}}])
    query = out.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.w for r in spark.table("streamed").collect()] == [60.0]
    with pytest.raises(UnsupportedOperator):
        compile_stream(stream, [{"$count": "n"}])
