"""Expression facts."""

import datetime as dt

import pytest

from docloom import UnsupportedOperator, compile_pipeline

DDL = "_id int, a int, b int, name string, tags array<string>, created_at string, nums array<bigint>, arr array<bigint>, s string, obj struct<x:int,y:int>, t timestamp, z int, msg string, bools array<boolean>"
ROW = (1, 10, 3, "  Alice  ", ["x", "y", "z"], "2026-03-28T10:11:12Z", [1, 2, 3], [3, 1, 2], "Äbc", (1, 2), dt.datetime(2024, 1, 31, 3, 4, 5, 6000), None, "Hello hello", [True, False])

FACTS = [
    ({"$abs": -5}, 5.0), ({"$add": ["$a", "$b", 1]}, 14.0), ({"$divide": ["$a", "$b"]}, 10 / 3), ({"$divide": [1, 0]}, None), ({"$mod": ["$a", "$b"]}, 1.0), ({"$mod": [-7, 3]}, -1.0),
    ({"$pow": [2, 3]}, 8.0), ({"$round": [3.14159, 2]}, 3.14), ({"$round": [2.5]}, 3.0), ({"$trunc": [3.149, 2]}, 3.14), ({"$sqrt": -1}, None), ({"$ln": 0}, None), ({"$log": [8, 2]}, 3.0), ({"$log10": 100}, 2.0), ({"$exp": 0}, 1.0),
    ({"$ceil": 1.2}, 2.0), ({"$floor": -1.2}, -2.0), ({"$subtract": ["$a", "$b"]}, 7.0), ({"$multiply": ["$a", "2"]}, 20.0),
    ({"$trim": {"input": "$name"}}, "Alice"), ({"$ltrim": {"input": "$name"}}, "Alice  "), ({"$rtrim": {"input": "xxAxx", "chars": "x"}}, "xxA"), ({"$ifNull": ["$z", 123]}, 123), ({"$concat": ["a", "$z"]}, None), ({"$concat": ["a", "b"]}, "ab"),
    ({"$switch": {"branches": [{"case": {"$gt": ["$a", 50]}, "then": "high"}, {"case": {"$gt": ["$a", 5]}, "then": "mid"}], "default": "low"}}, "mid"), ({"$cond": [{"$eq": ["$a", 10]}, 1, "x"]}, "1"), ({"$cond": {"if": "$z", "then": 1, "else": 2}}, 2),
    ({"$slice": ["$tags", -2]}, ["y", "z"]), ({"$slice": ["$tags", 1, 5]}, ["y", "z"]), ({"$range": [1, 5, 2]}, [1, 3]), ({"$range": [5, 1, -2]}, [5, 3]), ({"$range": [5, 1]}, []),
    ({"$year": "$created_at"}, 2026), ({"$month": "$created_at"}, 3), ({"$dayOfMonth": "$created_at"}, 28), ({"$millisecond": "$t"}, 6), ({"$hour": "$t"}, 3), ({"$minute": "$t"}, 4), ({"$second": "$t"}, 5), ({"$dayOfYear": "$t"}, 31), ({"$dayOfWeek": "$t"}, 4), ({"$week": "$t"}, 4), ({"$isoWeek": "$t"}, 5), ({"$isoWeekYear": "$t"}, 2024), ({"$isoDayOfWeek": "$t"}, 3),
    ({"$map": {"input": "$nums", "as": "n", "in": {"$add": ["$$n", 1]}}}, [2.0, 3.0, 4.0]), ({"$map": {"input": "$nums", "in": "$$index"}}, [0, 1, 2]), ({"$filter": {"input": "$nums", "as": "n", "cond": {"$gte": ["$$n", 2]}}}, [2, 3]), ({"$filter": {"input": "$nums", "cond": {"$gte": ["$$this", 1]}, "limit": 2}}, [1, 2]),
    ({"$reduce": {"input": "$nums", "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 6.0), ({"$sortArray": {"input": "$arr", "sortBy": 1}}, [1, 2, 3]), ({"$sortArray": {"input": "$arr", "sortBy": -1}}, [3, 2, 1]),
    ({"$substrCP": ["$s", 0, 2]}, "Äb"), ({"$substrBytes": ["$s", 2, 1]}, "b"), ({"$substr": ["abc", 1, -1]}, ""), ({"$strLenCP": "$s"}, 3), ({"$strLenBytes": "$s"}, 4), ({"$indexOfBytes": ["$s", "b"]}, 2), ({"$indexOfCP": ["$s", "b"]}, 1), ({"$indexOfCP": ["$s", "q"]}, -1), ({"$indexOfCP": ["abcabc", "b", 2]}, 4),
    ({"$dateToString": {"date": "$created_at", "format": "%Y-%m-%d"}}, "2026-03-28"), ({"$dateToString": {"date": "$t"}}, "2024-01-31T03:04:05.006Z"), ({"$dateToString": {"date": {"$dateAdd": {"startDate": "$created_at", "unit": "day", "amount": 1}}, "format": "%Y-%m-%d"}}, "2026-03-29"), ({"$dateToString": {"date": {"$dateAdd": {"startDate": "$t", "unit": "month", "amount": 1}}, "format": "%m/%d"}}, "03/02"), ({"$dateToString": {"date": {"$dateSubtract": {"startDate": "$t", "unit": "hour", "amount": 4}}, "format": "%d %H"}}, "30 23"),
    ({"$hour": {"$dateTrunc": {"date": "$created_at", "unit": "hour"}}}, 10), ({"$dateToString": {"date": {"$dateTrunc": {"date": "$t", "unit": "week"}}, "format": "%d"}}, "28"), ({"$dateToString": {"date": {"$dateTrunc": {"date": "$t", "unit": "hour", "binSize": 2}}, "format": "%H"}}, "02"),
    ({"$dateDiff": {"startDate": "2026-03-28T10:00:00Z", "endDate": "2026-03-28T13:30:00Z", "unit": "hour"}}, 3), ({"$dateToParts": {"date": "$t"}}, {"year": 2024, "month": 1, "day": 31, "hour": 3, "minute": 4, "second": 5, "millisecond": 6}),
    ({"$dateToString": {"date": {"$dateFromParts": {"year": 2023, "month": 14, "day": 1}}, "format": "%Y-%m-%d"}}, "2024-02-01"), ({"$year": {"$dateFromString": {"dateString": "03/04/2020", "format": "%m/%d/%Y"}}}, 2020), ({"$dateFromString": {"dateString": "nope"}}, None), ({"$year": {"$toDate": 1577836800}}, 2020),
    ({"$subtract": [{"$toDate": "2024-01-01T00:00:01Z"}, {"$toDate": "2024-01-01"}]}, 1000), ({"$dateToString": {"date": {"$add": ["$t", 86400000]}, "format": "%d"}}, "01"),
    ({"$getField": {"field": "x", "input": "$obj"}}, 1), ({"$setField": {"field": "y", "input": "$obj", "value": 9}}, {"x": 1, "y": 9}), ({"$unsetField": {"field": "x", "input": "$obj"}}, {"y": 2}), ({"$mergeObjects": ["$obj", {"y": 10, "d": 4}]}, {"x": 1, "y": 10, "d": 4}), ({"$objectToArray": "$obj"}, [{"k": "x", "v": 1}, {"k": "y", "v": 2}]), ({"$arrayToObject": {"$literal": [{"k": "a", "v": 1}, {"k": "a", "v": 2}]}}, {"a": 2}),
    ({"$indexOfArray": ["$tags", "y"]}, 1), ({"$indexOfArray": ["$tags", "q"]}, -1), ({"$strcasecmp": ["Hello", "hello"]}, 0), ({"$toInt": "123"}, 123), ({"$toLong": 3.9}, 3), ({"$toInt": "x"}, None), ({"$toDouble": "1.25"}, 1.25), ({"$toBool": 0}, False), ({"$toBool": "$z"}, None), ({"$convert": {"input": "5", "to": "int"}}, 5), ({"$convert": {"input": "q", "to": "int", "onError": -1}}, -1), ({"$convert": {"input": "$z", "to": "int", "onNull": 7}}, 7), ({"$toString": 5.0}, "5"),
    ({"$type": "$obj"}, "object"), ({"$type": "$z"}, "null"), ({"$type": "$tags"}, "array"), ({"$type": "$s"}, "string"), ({"$regexMatch": {"input": "$msg", "regex": "^hello", "options": "i"}}, True), ({"$regexFind": {"input": "$s", "regex": "b"}}, {"match": "b", "idx": 2}), ({"$regexFind": {"input": "$s", "regex": "q"}}, None), ({"$regexFindAll": {"input": "$msg", "regex": "hello", "options": "i"}}, [{"match": "Hello", "idx": 0}, {"match": "hello", "idx": 6}]),
    ({"$split": ["a.b.", "."]}, ["a", "b", ""]), ({"$replaceOne": {"input": "aba", "find": "a", "replacement": "c"}}, "cba"), ({"$replaceAll": {"input": "aba", "find": "a", "replacement": "c"}}, "cbc"), ({"$toLower": "AB"}, "ab"), ({"$toUpper": "ab"}, "AB"),
    ({"$isArray": "$tags"}, True), ({"$isArray": "$a"}, False), ({"$in": ["y", "$tags"]}, True), ({"$in": [["q", "x"], "$tags"]}, True), ({"$in": [1, "$a"]}, False), ({"$allElementsTrue": "$bools"}, False), ({"$anyElementTrue": "$bools"}, True), ({"$arrayElemAt": ["$tags", -1]}, "z"), ({"$arrayElemAt": ["$tags", 9]}, None), ({"$concatArrays": ["$tags", {"$literal": ["q"]}]}, ["x", "y", "z", "q"]), ({"$first": "$tags"}, "x"), ({"$last": "$tags"}, "z"), ({"$reverseArray": "$tags"}, ["z", "y", "x"]),
    ({"$setUnion": ["$nums", "$arr"]}, [1, 2, 3]), ({"$setIntersection": ["$arr", {"$literal": [3, 1, 9]}]}, [1, 3]), ({"$setDifference": [{"$literal": [1, 1, 2]}, {"$literal": [2]}]}, [1, 1]), ({"$setEquals": ["$nums", "$arr"]}, True), ({"$setIsSubset": [{"$literal": [1]}, "$arr"]}, True), ({"$zip": {"inputs": ["$nums", "$arr"]}}, [[1, 3], [2, 1], [3, 2]]), ({"$zip": {"inputs": [{"$literal": [1]}, {"$literal": [2, 3]}], "useLongestLength": True, "defaults": [0, 0]}}, [[1, 2], [0, 3]]),
    ({"$and": [1, "x"]}, True), ({"$or": [0, "", "$z"]}, False), ({"$not": ["$z"]}, True), ({"$eq": ["$z", None]}, True), ({"$ne": ["$z", None]}, False), ({"$gt": ["$z", 5]}, True), ({"$lt": ["$a", 20]}, True), ({"$lte": ["$a", 10]}, True), ({"$gte": ["b", "a"]}, True), ({"$cmp": ["$a", "$b"]}, 1), ({"$eq": ["5", 5]}, True),
    ({"$let": {"vars": {"q": {"$add": ["$a", 1]}}, "in": {"$multiply": ["$$q", 2]}}}, 22.0), ({"$literal": "$a"}, "$a"), ("$$ROOT.obj.y", 2), ("$tags.x", None), ({"p": "$a"}, {"p": "$a"}), ("$size" if False else {"$size": "$tags"}, 3),
]


def test_facts(spark):
    df = spark.createDataFrame([ROW], DDL)
    got = compile_pipeline(df, [{"$addFields": {f"f{k}": e for k, (e, _) in enumerate(FACTS)}}]).first().asDict(recursive=True)
    bad = {}
    for k, (e, want) in enumerate(FACTS):
        have = got[f"f{k}"]
        if not (have == want or (isinstance(want, float) and have == pytest.approx(want))):
            bad[str(e)] = (have, want)
    assert not bad


def test_rand_and_unknown(spark):
    df = spark.createDataFrame([ROW], DDL)
    assert 0 <= compile_pipeline(df, [{"$addFields": {"r": {"$rand": {}}}}]).first().r < 1
    for e in ({"$sum": "$nums"}, {"$meta": "textScore"}):
        with pytest.raises(UnsupportedOperator):
            compile_pipeline(df, [{"$addFields": {"r": e}}])
