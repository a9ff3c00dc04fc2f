"""Fields of any name, whole numbers above 2^53, and dates under any session time zone."""

import datetime as dt
from decimal import Decimal

import pytest

from docloom import compile_pipeline
from docloom.errors import BadSpec
from docloom.sources.collection import Engine


@pytest.fixture
def far_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def test_fields_with_leading_underscores_stay(spark):
    c = Engine(spark).register("c", spark.createDataFrame([(1, 7, "x"), (2, 8, "y")], "_id int, __v int, s string"))
    assert [tuple(r) for r in c.find({"__v": 8}).collect()] == [(2, 8, "y")]
    got = c.aggregate([{"$lookup": {"from": "c", "localField": "__v", "foreignField": "__v", "as": "m"}}, {"$unwind": "$m"}, {"$sort": {"__v": -1}}, {"$project": {"__v": 1, "r": "$$ROOT.__v", "w": "$m.__v"}}]).collect()
    assert [tuple(r) for r in got] == [(8, 8, 8), (7, 7, 7)]
    c.update({"__v": 7}, {"$inc": {"__v": 1}})
    assert sorted(r.asDict()["__v"] for r in c.find().collect()) == [8, 8]
    with pytest.raises(BadSpec):
        compile_pipeline(spark.createDataFrame([(1,)], "`~~ord` int"), [])


def test_longs_are_compared_exactly(spark):
    big = 1 << 53
    engine = Engine(spark)
    a = engine.register("a", spark.createDataFrame([(big,), (big + 1,)], "n long"))
    engine.register("b", spark.createDataFrame([(big, big + 1), (big + 1, None)], "m long, up long"))
    joined = a.aggregate([{"$lookup": {"from": "b", "let": {"n": "$n"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$m", "$$n"]}}}], "as": "r"}}, {"$project": {"n": 1, "k": {"$size": "$r"}, "c": {"$cmp": ["$n", big]}}}]).collect()
    assert sorted((r.n, r.k, r.c) for r in joined) == [(big, 1, 0), (big + 1, 1, 1)]
    walked = a.aggregate([{"$graphLookup": {"from": "b", "startWith": "$n", "connectFromField": "up", "connectToField": "m", "as": "w"}}, {"$project": {"n": 1, "k": {"$size": "$w"}}}]).collect()
    assert sorted((r.n, r.k) for r in walked) == [(big, 2), (big + 1, 1)]


DATES = [
    ({"$hour": "$s"}, 10), ({"$hour": "$t"}, 2), ({"$hour": "$w"}, 2), ({"$dayOfMonth": "$d"}, 10), ({"$hour": "$d"}, 0), ({"$hour": {"$toDate": "2024-03-10T02:30:00"}}, 2), ({"$hour": {"$toDate": "2024-03-10T02:30:00+02:00"}}, 0),
    ({"$dateToString": {"date": "$s"}}, "2026-03-28T10:11:12.000Z"), ({"$dateToString": {"date": "$w", "format": "%H:%M:%S.%L %z"}}, "02:30:15.250 +0000"), ({"$toString": "$t"}, "2024-03-10T02:30:15.250Z"),
    ({"$dateToString": {"date": {"$dateTrunc": {"date": "$w", "unit": "hour"}}}}, "2024-03-10T02:00:00.000Z"), ({"$dateToString": {"date": {"$dateTrunc": {"date": "$t", "unit": "week"}}, "format": "%d %H"}}, "10 00"), ({"$dateToString": {"date": {"$dateTrunc": {"date": "$t", "unit": "month", "binSize": 2}}, "format": "%m%d %H"}}, "0301 00"),
    ({"$dateToString": {"date": {"$dateAdd": {"startDate": "$w", "unit": "month", "amount": -1}}}}, "2024-02-10T02:30:15.250Z"), ({"$dateToString": {"date": {"$dateFromString": {"dateString": "10.03.2024 02:30", "format": "%d.%m.%Y %H:%M"}}}}, "2024-03-10T02:30:00.000Z"),
    ({"$dateToString": {"date": {"$dateFromParts": {"year": 2024, "month": 3, "day": 10, "hour": 2}}}}, "2024-03-10T02:00:00.000Z"), ({"$dateToParts": {"date": "$w"}}, {"year": 2024, "month": 3, "day": 10, "hour": 2, "minute": 30, "second": 15, "millisecond": 250}),
    ({"$eq": ["$w", "$t"]}, True), ({"$subtract": ["$w", "$t"]}, 0), ({"$dateDiff": {"startDate": "2023-01-31", "endDate": "2023-03-01", "unit": "month"}}, 0), ({"$dateDiff": {"startDate": "2023-01-31", "endDate": "2023-03-03", "unit": "month"}}, 1), ({"$dateDiff": {"startDate": "2023-03-03", "endDate": "2023-01-31", "unit": "month"}}, -1),
    ({"$dateDiff": {"startDate": "2020-02-29", "endDate": "2021-02-28", "unit": "year"}}, 0), ({"$dateDiff": {"startDate": "2020-02-29", "endDate": "2021-03-01", "unit": "year"}}, 1), ({"$dateDiff": {"startDate": "2023-01-15", "endDate": "2024-01-14", "unit": "quarter"}}, 3), ({"$dateDiff": {"startDate": "$nope", "endDate": "$t", "unit": "month"}}, None),
]


def test_dates_are_utc_in_any_session(far_zone):
    df = far_zone.sql("SELECT '2026-03-28T10:11:12Z' AS s, TIMESTAMP_LTZ '2024-03-10 02:30:15.25 UTC' AS t, TIMESTAMP_NTZ '2024-03-10 02:30:15.25' AS w, DATE '2024-03-10' AS d")
    got = compile_pipeline(df, [{"$addFields": {f"f{k}": e for k, (e, _) in enumerate(DATES)}}]).first().asDict(recursive=True)
    assert [got[f"f{k}"] for k in range(len(DATES))] == [want for _, want in DATES]
    assert compile_pipeline(df, [{"$match": {"w": dt.datetime(2024, 3, 10, 2, 30, 15, 250000), "t": dt.datetime(2024, 3, 10, 2, 30, 15, 250000, tzinfo=dt.UTC)}}]).count() == 1


def test_decimals_and_object_ids_go_in(spark):
    class ObjectId:
        def __str__(self):
            return "65f0c0ffee65f0c0ffee65f0"

    c = Engine(spark).collection("c")
    c.insert([{"_id": ObjectId(), "price": Decimal("12.50")}, {"_id": "x", "price": Decimal("1.25")}])
    assert sorted((r._id, float(r.price)) for r in c.find({"price": {"$gt": 1}}).collect()) == [("65f0c0ffee65f0c0ffee65f0", 12.5), ("x", 1.25)]
