"""Reads and writes of collections."""

import pytest

from docloom import DuplicateKey, Engine


def docs(c, **kw):
    return {r["_id"]: r.asDict(recursive=True) for r in c.find(**kw).collect()}


@pytest.fixture
def engine(spark):
    return Engine(spark)


def test_insert_find_count(engine):
    c = engine.collection("db.people")
    c.insert([{"_id": "1", "a": 1}, {"_id": "2", "a": 2, "b": "x"}])
    c.insert([{"_id": "3", "c": 1.5}])
    assert c.count() == 3 and c.count({"a": {"$gt": 1}}) == 1
    assert docs(c)["3"] == {"_id": "3", "a": None, "b": None, "c": 1.5}
    assert [r["_id"] for r in c.find({"a": {"$in": [1, 2]}}, sort={"a": -1}, skip=0, limit=1).collect()] == ["2"]
    assert len(c.insert([{"a": 9}])[0]) == 24
    assert engine.list_databases() == ["db"] and engine.list_collections("db") == ["db.people"]
    assert c.stats()["count"] == 4
    assert engine.drop_database("db") == 1 and engine.list_collections() == []


def test_unique_keys(engine):
    c = engine.collection("u")
    c.insert([{"_id": "1", "mail": "a", "tags": ["x", "y"]}, {"_id": "2", "mail": None, "tags": None}, {"_id": "3", "mail": None, "tags": ["z"]}])
    with pytest.raises(DuplicateKey):
        c.insert([{"_id": "1"}])
    c.create_index(["mail"], unique=True)
    c.create_index(["tags"], unique=True)
    with pytest.raises(DuplicateKey):
        c.insert([{"_id": "4", "mail": "a"}])
    with pytest.raises(DuplicateKey):
        c.insert([{"_id": "5", "tags": ["q", "x"]}])
    assert c.count() == 3
    c.drop_index("tags_1")
    c.insert([{"_id": "5", "tags": ["q", "x"]}])
    assert sorted(c.list_indexes()) == ["mail_1"]


def test_updates(engine):
    c = engine.collection("w")
    c.insert([{"_id": "1", "age": 25, "a": {"b": 1, "c": 2}, "tags": ["x"]}, {"_id": "2", "age": 30, "a": None, "tags": None}])
    got = c.update({"_id": "1"}, {"$set": {"address.city": "blr", "a.b": 5}, "$inc": {"age": 5, "counter.value": 5}, "$push": {"tags": "y"}})
    assert (got.matched, got.modified) == (1, 1)
    one, two = docs(c)["1"], docs(c)["2"]
    assert one["address"] == {"city": "blr"} and one["a"] == {"b": 5, "c": 2} and one["age"] == 30 and one["counter"] == {"value": 5} and one["tags"] == ["x", "y"]
    assert two["age"] == 30 and two["tags"] is None and two["address"] is None
    assert c.update({"age": 30}, {"$addToSet": {"tags": "y"}}, multi=True).modified == 1
    assert docs(c)["1"]["tags"] == ["x", "y"] and docs(c)["2"]["tags"] == ["y"]
    assert c.update({"age": 30}, {"$inc": {"age": 0.5}}).matched == 1
    assert docs(c)["1"]["age"] == 30.5 and docs(c)["2"]["age"] == 30
    c.update({"_id": "1"}, {"$unset": {"a.b": ""}})
    assert c.update({"_id": "9"}, {"$set": {"x": 1}}).matched == 0


def test_upsert_replace_delete(engine):
    c = engine.collection("x")
    c.insert([{"_id": "1", "a": {"b": 2}, "age": 1}])
    got = c.update({"a": {"b": 1}, "age": {"$gte": 10}, "_id": "7"}, {"$set": {"n": 1}}, upsert=True)
    assert got.upserted == "7" and docs(c)["7"]["a"] == {"b": 1} and docs(c)["7"]["age"] is None
    c.update({"_id": "1"}, {"age": 99})
    assert docs(c)["1"]["age"] == 99 and docs(c)["1"]["a"] is None
    c.insert([{"_id": "8", "age": 99}])
    assert c.delete({"age": 99}, limit=1) == 1 and c.count({"age": 99}) == 1
    assert c.delete({"age": 99}) == 1 and c.delete({"age": 99}) == 0


def test_inserts_append_and_are_held_against_all_keys(spark, monkeypatch):
    from docloom.sources import collection

    monkeypatch.setattr(collection, "MOST_PARTS", 3)
    c = collection.Engine(spark).collection("grows")
    for k in range(5):
        c.insert([{"_id": k, "tags": [f"a{k}", f"b{k}"]}])
    c.create_index(["tags"], unique=True)
    for docs in ([{"_id": 2}], [{"_id": 9, "tags": ["b3"]}], [{"_id": 7}, {"_id": 7}]):
        with pytest.raises(collection.DuplicateKey):
            c.insert(docs)
    c.insert([{"_id": 8, "extra": 1.5}])
    assert c.engine.parts["grows"] <= 3 and sorted((r._id, r.extra) for r in c.find().collect()) == [(0, None), (1, None), (2, None), (3, None), (4, None), (8, 1.5)]
