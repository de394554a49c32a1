"""Filters, pipelines, expressions and changes on the micro-fixtures of FIXTURES.md and on edge cases."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn import document
from tarn.database import Database, DuplicateKey, WriteConflict, list_databases
from tarn.functions.expr import compile_expression
from tarn.functions.match import compile_match
from tarn.functions.types import PipelineError
from tarn.operators.peephole import rewrite
from tarn.operators.stages import Frame, run


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def table(spark, db, ddl, rows, name="c"):
    db.tables[name] = spark.createDataFrame(rows, ddl)
    return db[name]


def value(spark, expr, ddl="x int", row=(1,)):
    df = spark.createDataFrame([row], ddl)
    return df.select(compile_expression(expr, df.schema).col.alias("v")).first()[0]


def hits(c, spec, **o):
    return c.find(spec, **o).count()


# ---- filters -------------------------------------------------------------------------------------------------------


def test_filters(spark, db):
    c = table(spark, db, "n int, tags array<string>", [(1, ["a", "b"]), (2, ["b", "c"]), (3, ["a", "c"]), (4, None)])
    for spec, n in [
        ({"n": {"$in": [1, 3]}}, 2), ({"n": {"$nin": [1, 2]}}, 2), ({"tags": {"$exists": True}}, 3), ({"tags": {"$exists": False}}, 1),
        ({"tags": {"$all": ["a", "b"]}}, 1), ({"tags": {"$all": []}}, 0), ({"tags": {"$size": 2}}, 3), ({"$and": [{"n": {"$gte": 2}}, {"n": {"$lte": 3}}]}, 2),
        ({"$or": [{"n": 1}, {"n": 4}]}, 2), ({"$nor": [{"n": 1}]}, 3), ({"tags": "a"}, 2), ({"tags": {"$ne": "a"}}, 2), ({"tags": ["a", "b"]}, 1),
        ({}, 4), ({"$or": []}, 0), ({"$and": []}, 4), ({"missing": None}, 4), ({"missing": 1}, 0), ({"missing": {"$ne": 1}}, 4), ({"tags": {"$in": ["c", None]}}, 3),
        ({"n": {"$not": {"$gt": 2}}}, 2), ({"tags.0": "a"}, 2), ({"n": {"$type": "number"}}, 4), ({"n": {"$mod": [2, 0]}}, 2), ({"tags": re.compile("^A", re.I)}, 2),
        ({"n": {"$bitsAllSet": [0]}}, 2), ({"n": {"$gt": "x"}}, 0), ({"n": {"$lt": 2.5}}, 2), ({"n": 1.0}, 1), ({"n": True}, 0),
    ]:
        assert hits(c, spec) == n, spec
    for bad in ({"n": {"$near": 1}}, {"$where": "x"}, {"$jsonSchema": {}}, {"n": {"$size": -1}}, {"n": {"$mod": [0, 1]}}, {"n": {"$foo": 1}}, {"$text": {}}):
        with pytest.raises(PipelineError):
            hits(c, bad)


def test_filters_are_two_valued_and_brackets_are_optional(spark, db):
    c = table(spark, db, "x int", [(1,), (7,), (None,)])
    assert hits(c, {"x": {"$lt": 5}}) == 1 and hits(c, {"x": {"$lt": 5}}, bracketing=False) == 2
    assert hits(c, {"x": {"$not": {"$lt": 5}}}) == 2 and hits(c, {"x": {"$ne": 1}}) == 2 and hits(c, {"$nor": [{"x": 1}]}) == 2
    assert hits(c, {"x": {"$lt": "a"}}, bracketing=False) == 3 and hits(c, {"x": {"$gte": None}}) == 1


def test_elem_match_and_regex(spark, db):
    c = table(spark, db, "results array<int>, items array<struct<name:string,qty:int>>", [([82, 70, 90], [("a", 5), ("b", 2)]), ([70, 90], None), ([], [])])
    assert hits(c, {"results": {"$elemMatch": {"$gte": 80, "$lt": 85}}}) == 1
    assert hits(c, {"items": {"$elemMatch": {"name": "a", "qty": {"$gt": 3}}}}) == 1
    assert hits(c, {"items": {"$elemMatch": {"name": "b", "qty": {"$gt": 3}}}}) == 0
    assert hits(c, {"items.qty": 2}) == 1 and hits(c, {"items": {"$elemMatch": {"$or": [{"qty": 2}, {"qty": 9}]}}}) == 1
    n = table(spark, db, "name string", [("Alice",), ("ALICE",), ("alice",), ("Bob",), (None,), ("",)], "names")
    assert hits(n, {"name": {"$regex": "^alice$", "$options": "i"}}) == 3 and hits(n, {"name": {"$not": re.compile("b$")}}) == 5
    assert hits(n, {"name": {"$in": [re.compile("^A"), "Bob"]}}) == 3 and hits(n, {"$text": {"$search": "LIC"}}) == 3


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("int").alias("a"), F.col("id").cast("double").alias("b"), F.lit("s").alias("c")).write.parquet(str(tmp_path / "t.parquet"))
    c = Database(spark, str(tmp_path))["t"]
    plan = c.explain(pipeline=[{"$match": {"a": {"$gte": 3}, "b": {"$lt": 7}}}, {"$project": {"a": 1}}])
    assert "GreaterThanOrEqual(a,3)" in plan and "LessThan(b,7.0)" in plan and "ReadSchema: struct<a:int,b:double>" in plan


# ---- expressions ---------------------------------------------------------------------------------------------------

T0 = dt.datetime(2024, 3, 15, 10, 30, 45)


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ({"$abs": -5}, 5.0), ({"$ceil": 4.3}, 5.0), ({"$floor": 4.9}, 4.0), ({"$mod": [7, 3]}, 1.0), ({"$mod": [-7, 3]}, -1.0), ({"$pow": [2, 10]}, 1024.0),
        ({"$sqrt": 9}, 3.0), ({"$subtract": [7, 3]}, 4), ({"$divide": [10.0, 4.0]}, 2.5), ({"$add": [1, None]}, None), ({"$add": []}, 0), ({"$multiply": [2, 3, 4]}, 24),
        ({"$round": [2.5, 0]}, 3.0), ({"$round": [-2.5]}, -3.0), ({"$round": [1.005, 2]}, 1.0), ({"$trunc": [-2.57, 1]}, -2.5), ({"$ln": 1}, 0.0), ({"$log": [8, 2]}, 3.0), ({"$log10": 1000}, 3.0),
        ({"$exp": 0}, 1.0), ({"$abs": ["$x"]}, 1.0), ({"$abs": "text"}, None),
        ({"$cmp": [1, 2]}, -1), ({"$cmp": [None, 0]}, -1), ({"$eq": [1, 1.0]}, True), ({"$gt": ["a", 5]}, True), ({"$lt": [None, 5]}, True), ({"$lte": [None, None]}, True), ({"$ne": [None, 1]}, True),
        ({"$and": []}, True), ({"$or": []}, False), ({"$and": [1, "a"]}, True), ({"$or": [0, "", None, False]}, False), ({"$not": [0]}, True),
        ({"$cond": [True, 1, 2.5]}, 1.0), ({"$cond": {"if": 0, "then": 1, "else": 2}}, 2), ({"$ifNull": [None, None, 7]}, 7),
        ({"$switch": {"branches": [{"case": False, "then": 1}], "default": 2}}, 2),
        ({"$type": 42}, "int"), ({"$type": 2**40}, "long"), ({"$type": "$nope"}, "null"), ({"$type": [[1]]}, "array"), ({"$toString": 42}, "42"), ({"$toString": 3.0}, "3"), ({"$toString": 2.5}, "2.5"),
        ({"$toInt": "100"}, 100), ({"$toInt": 3.7}, 3), ({"$toInt": -3.7}, -3), ({"$toLong": "100"}, 100), ({"$toDouble": "100"}, 100.0), ({"$toBool": "x"}, True), ({"$toBool": 0}, False),
        ({"$toDate": 1000}, dt.datetime(1970, 1, 1, 0, 0, 1)), ({"$toDate": "2024-03-15T10:30:45Z"}, T0), ({"$toString": {"$toDate": 1500}}, "1970-01-01T00:00:01.5Z"),
        ({"$convert": {"input": "x", "to": "int", "onError": -1}}, -1), ({"$convert": {"input": None, "to": "int", "onNull": 9}}, 9), ({"$toObjectId": "ABCDEF0123456789abcdef01"}, "abcdef0123456789abcdef01"),
        ({"$concat": ["a", None]}, None), ({"$concat": ["a", "b"]}, "ab"), ({"$toUpper": None}, ""), ({"$toLower": "AB"}, "ab"), ({"$trim": "  Hello World  "}, "Hello World"),
        ({"$trim": {"input": "xxhixx", "chars": "x"}}, "hi"), ({"$ltrim": "  a "}, "a "), ({"$rtrim": "  a "}, "  a"), ({"$split": ["a.b.", "."]}, ["a", "b", ""]), ({"$strLenBytes": "é"}, 2), ({"$strLenCP": "é"}, 1),
        ({"$substr": ["  Hello World  ", 2, 5]}, "Hello"), ({"$substr": ["abc", 1, -1]}, "bc"), ({"$substrCP": ["éab", 1, 1]}, "a"), ({"$substrBytes": ["abc", -3, 2]}, "ab"),
        ({"$indexOfCP": ["ébca", "c"]}, 2), ({"$indexOfBytes": ["ébca", "c"]}, 3), ({"$indexOfCP": [None, "c"]}, -1), ({"$indexOfCP": ["abcabc", "c", 3]}, 5), ({"$indexOfCP": ["abcabc", "c", 3, 5]}, -1),
        ({"$strcasecmp": ["A", "a"]}, 0), ({"$strcasecmp": ["b", "A"]}, 1), ({"$regexMatch": {"input": "Abc", "regex": "^a", "options": "i"}}, True), ({"$regexMatch": {"input": None, "regex": "a"}}, False),
        ({"$replaceOne": {"input": "aXbX", "find": "X", "replacement": "-"}}, "a-bX"), ({"$replaceOne": {"input": "abc", "find": "X", "replacement": "-"}}, "abc"), ({"$replaceAll": {"input": "aXbX", "find": "X", "replacement": "-"}}, "a-b-"),
        ({"$arrayElemAt": [[1, 2, 3], -1]}, 3), ({"$arrayElemAt": [[1], 5]}, None), ({"$concatArrays": [[1], [2, 3]]}, [1, 2, 3]), ({"$concatArrays": [[1], None]}, None),
        ({"$filter": {"input": [1, 2, 3], "cond": {"$gt": ["$$this", 1]}}}, [2, 3]), ({"$filter": {"input": [1, 2, 3], "as": "e", "cond": {"$gt": ["$$e", 1]}, "limit": 1}}, [2]),
        ({"$map": {"input": [1, 2], "as": "e", "in": {"$multiply": ["$$e", 2]}}}, [2, 4]), ({"$reduce": {"input": [1, 2, 3], "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 6),
        ({"$reduce": {"input": [1.5, 2], "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 3.5),
        ({"$first": [[1, 2]]}, 1), ({"$last": [[]]}, None), ({"$in": [2, [1, 2]]}, True), ({"$in": [5, [1, None]]}, False), ({"$indexOfArray": [["a", "b", "c", "b"], "b"]}, 1), ({"$indexOfArray": [["a"], "z"]}, -1),
        ({"$indexOfArray": [["a", "b", "b"], "b", 2]}, 2), ({"$isArray": [[1]]}, True), ({"$isArray": "$x"}, False), ({"$reverseArray": [[1, 2, 3]]}, [3, 2, 1]), ({"$size": [[1, 2]]}, 2),
        ({"$slice": [[1, 2, 3, 4, 5], 1, 3]}, [2, 3, 4]), ({"$slice": [[1, 2, 3], -2]}, [2, 3]), ({"$slice": [[1, 2, 3], -5, 2]}, [1, 2]), ({"$slice": [[1, 2], 9]}, [1, 2]),
        ({"$zip": {"inputs": [[1, 2], [3]]}}, [[1, 3]]), ({"$zip": {"inputs": [[1, 2], [3]], "useLongestLength": True, "defaults": [0, 9]}}, [[1, 3], [2, 9]]),
        ({"$range": [0, 5]}, [0, 1, 2, 3, 4]), ({"$range": [5, 0, -2]}, [5, 3, 1]), ({"$range": [0, 0]}, []), ({"$range": [0, 3, 0]}, [0, 1, 2]), ({"$range": [3, 0]}, []),
        ({"$setEquals": [[1, 2, 2], [2, 1]]}, True), ({"$setIntersection": [[1, 2, 3], [3, 1]]}, [1, 3]), ({"$setUnion": [[1, 2], [2, 3]]}, [1, 2, 3]), ({"$setDifference": [[1, 2, 3], [2]]}, [1, 3]),
        ({"$setIsSubset": [[1], [1, 2]]}, True), ({"$anyElementTrue": [[0, 1]]}, True), ({"$allElementsTrue": [[0, 1]]}, False), ({"$allElementsTrue": [[]]}, True),
        ({"$let": {"vars": {"p": 10, "q": "$x"}, "in": {"$multiply": ["$$p", "$$q"]}}}, 10), ({"$literal": "$x"}, "$x"), ("$$ROOT.x", 1), ("$$CURRENT.x", 1),
        ({"$mergeObjects": [{"x": 1}, {"y": 2}]}, (1, 2)), ({"$objectToArray": {"a": 1, "b": 2}}, [("a", 1), ("b", 2)]), ({"$arrayToObject": [[{"k": "a", "v": 1}, {"k": "a", "v": 2}]]}, {"a": 2}), ({"$arrayToObject": [[["k", "v"]]]}, {"k": "v"}),
        ({"$year": T0}, 2024), ({"$month": T0}, 3), ({"$dayOfMonth": T0}, 15), ({"$hour": T0}, 10), ({"$minute": T0}, 30), ({"$second": T0}, 45), ({"$millisecond": T0}, 0), ({"$dayOfYear": T0}, 75), ({"$dayOfWeek": T0}, 6),
        ({"$week": T0}, 11), ({"$isoWeek": T0}, 11), ({"$isoDayOfWeek": T0}, 5), ({"$isoWeekYear": dt.datetime(2021, 1, 1)}, 2020), ({"$year": "text"}, None), ({"$hour": {"date": T0, "timezone": "+02:00"}}, 12),
        ({"$dateToString": {"date": T0}}, "2024-03-15T10:30:45.000Z"), ({"$dateToString": {"date": T0, "format": "%Y%%%m|%j|%u|%V|%Z"}}, "2024%03|075|5|11|UTC"), ({"$dateToString": {"date": None, "onNull": "-"}}, "-"),
        ({"$dateFromString": {"dateString": "2024-03-15"}}, dt.datetime(2024, 3, 15)), ({"$dateFromString": {"dateString": "15/03/2024", "format": "%d/%m/%Y"}}, dt.datetime(2024, 3, 15)), ({"$dateFromString": {"dateString": "x", "onError": None}}, None),
        ({"$dateAdd": {"startDate": dt.datetime(2024, 1, 31), "unit": "month", "amount": 1}}, dt.datetime(2024, 2, 29)), ({"$dateAdd": {"startDate": T0, "unit": "week", "amount": -1}}, dt.datetime(2024, 3, 8, 10, 30, 45)),
        ({"$dateDiff": {"startDate": T0, "endDate": dt.datetime(2024, 3, 16), "unit": "day"}}, 0), ({"$dateDiff": {"startDate": dt.datetime(2023, 12, 31), "endDate": T0, "unit": "year"}}, 1), ({"$dateDiff": {"startDate": dt.datetime(2023, 12, 31), "endDate": T0, "unit": "quarter"}}, 1),
        ({"$dateTrunc": {"date": T0, "unit": "week"}}, dt.datetime(2024, 3, 10)), ({"$dateTrunc": {"date": T0, "unit": "hour"}}, dt.datetime(2024, 3, 15, 10)), ({"$subtract": [T0, dt.datetime(2024, 3, 15)]}, 37845000),
        ({"$add": [T0, 1000]}, dt.datetime(2024, 3, 15, 10, 30, 46)), ({"$let": {"vars": {"m": {"$regexFind": {"input": "xab", "regex": "(a)(z)?"}}}, "in": "$$m"}}, ("a", 1, ["a", None])),
        ({"$regexFindAll": {"input": "a1b22", "regex": "[0-9]+"}}, [("1", 1, []), ("22", 3, [])]), ({"$regexFind": {"input": "x", "regex": "y"}}, None),
    ],
    ids=lambda v: None,
)
def test_expression(spark, expr, want):
    got = value(spark, expr)
    if isinstance(want, tuple):
        got = tuple(got)
    elif isinstance(want, list) and want and isinstance(want[0], tuple):
        got = [tuple(g) for g in got]
    assert got == want if not isinstance(want, float) else abs(got - want) < 1e-12


def test_expression_errors(spark):
    for bad in ({"$nope": 1}, {"$size": "$x"}, {"$concat": [1]}, {"$in": [1, 2]}, {"$subtract": [1]}, "$$undefined", {"$dateAdd": {"startDate": T0, "unit": "eon", "amount": 1}}, {"$convert": {"input": 1}}):
        with pytest.raises(PipelineError):
            value(spark, bad)
    for bad in ({"$divide": [1, 0]}, {"$mod": [1, 0]}, {"$toInt": "x"}, {"$toDate": "nonsense"}, {"$toObjectId": "zz"}, {"$dateFromString": {"dateString": "x"}}, {"$switch": {"branches": [{"case": {"$gt": ["$x", 5]}, "then": 1}]}}):
        with pytest.raises(Exception, match="(?i)error|cannot|zero|invalid|no branch"):
            value(spark, bad)


# ---- stages --------------------------------------------------------------------------------------------------------


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_group_and_sort(spark, db):
    c = table(spark, db, "dept string, salary int", [("eng", 100000), ("eng", 120000), ("mkt", 80000), (None, None)])
    assert rows(c.aggregate([{"$match": {"dept": "eng"}}, {"$count": "n"}])) == [(2,)]
    got = c.aggregate([{"$group": {"_id": "$dept", "n": {"$sum": 1}, "s": {"$sum": "$salary"}, "a": {"$avg": "$salary"}, "p": {"$push": "$salary"}, "d": {"$stdDevSamp": "$salary"}}}, {"$sort": {"_id": 1}}])
    assert rows(got)[0] == (None, 1, 0, None, [None], None) and rows(got)[1][:4] == ("eng", 2, 220000, 110000.0)
    assert rows(c.aggregate([{"$group": {"_id": None, "n": {"$count": {}}}}])) == [(None, 4)]
    assert rows(c.aggregate([{"$match": {"dept": "x"}}, {"$group": {"_id": None, "n": {"$sum": 1}}}])) == []
    ordered = c.aggregate([{"$sort": {"dept": 1, "salary": -1}}, {"$group": {"_id": 1, "f": {"$first": "$salary"}, "l": {"$last": "$salary"}, "p": {"$push": "$salary"}}}])
    assert rows(ordered)[0][1:] == (None, 80000, [None, 120000, 100000, 80000])
    assert rows(c.aggregate([{"$sort": {"salary": -1}}, {"$group": {"_id": 1, "f": {"$first": "$dept"}, "l": {"$last": "$dept"}}}]))[0][1:] == ("eng", None)
    sets = c.aggregate([{"$group": {"_id": None, "s": {"$addToSet": "$dept"}, "lo": {"$min": "$salary"}, "hi": {"$max": "$salary"}}}])
    assert rows(sets)[0][1:] == ([None, "eng", "mkt"], 80000, 120000)
    for bad in ({"$median": "$salary"}, 5):
        with pytest.raises(PipelineError):
            c.aggregate([{"$group": {"_id": None, "m": bad}}])


def test_row_stages(spark, db):
    c = table(spark, db, "_id int, user struct<name:string,age:int,secret:string>, tags array<string>", [(1, ("alice", 25, "s"), ["a", "b"]), (2, None, []), (3, ("bob", None, None), None)])
    assert c.aggregate([{"$project": {"user.name": 1}}]).schema.simpleString() == "struct<_id:int,user:struct<name:string>>"
    assert c.aggregate([{"$project": {"_id": 0, "n": "$user.name", "k": {"$literal": 1}}}]).columns == ["n", "k"]
    assert c.aggregate([{"$project": {"user.secret": 0, "tags": 0}}]).schema.simpleString() == "struct<_id:int,user:struct<name:string,age:int>>"
    got = c.aggregate([{"$addFields": {"user.age": {"$add": ["$_id", 1]}, "user.old": "$user.age", "z.y": 1}}, {"$sort": {"_id": 1}}, {"$project": {"_id": 0, "a": "$user.age", "o": "$user.old", "y": "$z.y"}}])
    assert rows(got) == [(2, 25, 1), (3, None, 1), (4, None, 1)]
    assert rows(c.aggregate([{"$unset": ["user.secret", "tags", "_id"]}, {"$match": {"user.name": "bob"}}])) == [(("bob", None),)]
    assert sorted(rows(c.aggregate([{"$unwind": "$tags"}, {"$project": {"tags": 1}}]))) == [(1, "a"), (1, "b")]
    kept = c.aggregate([{"$unwind": {"path": "$tags", "includeArrayIndex": "i", "preserveNullAndEmptyArrays": True}}, {"$project": {"tags": 1, "i": 1}}])
    assert sorted(rows(kept), key=str) == [(1, "a", 0), (1, "b", 1), (2, None, None), (3, None, None)]
    assert c.aggregate([{"$unwind": "$_id"}]).count() == 3 and c.aggregate([{"$unwind": "$user"}]).count() == 2 and c.aggregate([{"$unwind": "$none"}]).count() == 0
    assert rows(c.aggregate([{"$match": {"user": {"$ne": None}}}, {"$replaceRoot": {"newRoot": "$user"}}, {"$sort": {"name": 1}}, {"$project": {"name": 1}}])) == [("alice",), ("bob",)]
    red = c.aggregate([{"$redact": {"$cond": [{"$eq": ["$secret", "s"]}, "$$PRUNE", "$$DESCEND"]}}, {"$sort": {"_id": 1}}])
    assert [r.user is None for r in red.collect()] == [True, True, False]
    assert rows(c.aggregate([{"$sort": {"_id": -1}}, {"$skip": 1}, {"$limit": 1}, {"$project": {"_id": 1}}])) == [(2,)]
    assert c.aggregate([{"$limit": 0}]).count() == 0 and c.aggregate([{"$sample": {"size": 2}}]).count() == 2


def test_buckets(spark, db):
    c = table(spark, db, "score int", [(15,), (42,), (78,), (91,), (55,)])
    assert rows(c.aggregate([{"$bucket": {"groupBy": "$score", "boundaries": [0, 50, 75, 100]}}])) == [(0, 2), (50, 1), (75, 2)]
    got = c.aggregate([{"$bucket": {"groupBy": "$score", "boundaries": [0, 10, 50], "default": 99, "output": {"t": {"$sum": "$score"}, "p": {"$avg": "$score"}}}}])
    assert rows(got) == [(0, 0, 0, None), (10, 2, 57, 28.5), (99, 3, 224, pytest.approx(224 / 3))]
    with pytest.raises(Exception, match="outside the boundaries"):
        c.aggregate([{"$bucket": {"groupBy": "$score", "boundaries": [0, 50]}}]).collect()
    auto = c.aggregate([{"$bucketAuto": {"groupBy": "$score", "buckets": 2}}])
    assert rows(auto) == [((15, 55), 3), ((78, 91), 2)]
    assert rows(c.aggregate([{"$bucketAuto": {"groupBy": "$score", "buckets": 9}}]))[0] == ((15, 15), 1)
    assert c.aggregate([{"$match": {"score": 0}}, {"$bucketAuto": {"groupBy": "$score", "buckets": 3}}]).count() == 0


def test_lookup_union_facet(spark, db):
    o = table(spark, db, "_id int, userID int, amount int", [(1, 1, 10), (2, 2, 20), (3, None, 30), (4, 9, 40)], "orders")
    table(spark, db, "_id int, name string", [(1, "a"), (2, "b"), (2, "bb"), (None, "nobody")], "users")
    look = {"$lookup": {"from": "users", "localField": "userID", "foreignField": "_id", "as": "user"}}
    got = {r._id: len(r.user) for r in o.aggregate([look]).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 0}
    assert sorted(rows(o.aggregate([look, {"$unwind": "$user"}, {"$project": {"n": "$user.name"}}]))) == [(1, "a"), (2, "b"), (2, "bb"), (3, "nobody")]
    assert o.aggregate([look, {"$unwind": {"path": "$user", "preserveNullAndEmptyArrays": True}}]).count() == 5
    assert rows(o.aggregate([look, {"$match": {"user": {"$size": 0}}}, {"$project": {"_id": 1}}])) == [(4,)]
    assert "LeftAnti" in o.explain(pipeline=[look, {"$match": {"user": []}}]) and "collect_list" not in o.explain(pipeline=[look, {"$unwind": "$user"}])
    semi = [look, {"$match": {"user": {"$ne": []}}}, {"$unset": "user"}]
    assert sorted(r._id for r in o.aggregate(semi).collect()) == [1, 2, 3] and "LeftSemi" in o.explain(pipeline=semi)
    free = o.aggregate([{"$lookup": {"from": "users", "pipeline": [{"$match": {"name": "a"}}], "as": "u"}}, {"$project": {"n": {"$size": "$u"}}}])
    assert {r.n for r in free.collect()} == {1}
    let = {"$lookup": {"from": "users", "let": {"k": "$userID"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$_id", "$$k"]}, {"$ne": ["$name", "bb"]}]}}}, {"$project": {"_id": 0, "name": 1}}], "as": "u"}}
    assert {r._id: [x.name for x in r.u] for r in o.aggregate([let]).collect()} == {1: ["a"], 2: ["b"], 3: ["nobody"], 4: []}
    arr = table(spark, db, "k array<int>", [([1, 2],), ([],), (None,)], "arr")
    assert sorted(len(r.u) for r in arr.aggregate([{"$lookup": {"from": "users", "localField": "k", "foreignField": "_id", "as": "u"}}]).collect()) == [0, 0, 3]
    assert o.aggregate([{"$project": {"n": "$amount"}}, {"$unionWith": {"coll": "users", "pipeline": [{"$project": {"name": 1}}]}}]).count() == 8
    f = o.aggregate([{"$facet": {"by": [{"$group": {"_id": "$userID", "s": {"$sum": "$amount"}}}, {"$sort": {"s": -1}}], "n": [{"$count": "n"}]}}]).first()
    assert [x.s for x in f.by] == [40, 30, 20, 10] and f.n[0].n == 4
    assert [tuple(r) for r in o.aggregate([{"$sortByCount": {"$gt": ["$amount", 15]}}]).collect()] == [(True, 3), (False, 1)]


def test_pipelines_are_checked_before_they_run(spark, db):
    c = table(spark, db, "x int", [(1,)])
    for bad in ([{"$densify": {}}], [{"$setWindowFields": {}}], [{"a": 1, "b": 2}], {"$match": {}}, [{"$facet": {"a": [{"$nope": 1}]}}], [{"$limit": -1}], [{"$lookup": {"from": "x"}}]):
        with pytest.raises(PipelineError):
            c.aggregate(bad)
    assert db.aggregate([{"$count": "n"}]).first()[0] == 0
    assert rewrite([{"$match": {"a": 1}}, {"$match": {"b": 2}}]) == [{"$match": {"$and": [{"a": 1}, {"b": 2}]}}]


# ---- find and changes ----------------------------------------------------------------------------------------------


def test_find_projection(spark, db):
    c = table(spark, db, "_id int, arr array<int>, items array<struct<n:string,q:int>>", [(1, [10, 20, 30, 40], [("a", 1), ("b", 2)])])
    one = lambda p: c.find({}, p).first()
    assert one({"arr": {"$slice": 2}}).asDict(True) == {"_id": 1, "arr": [10, 20], "items": [{"n": "a", "q": 1}, {"n": "b", "q": 2}]}
    assert one({"_id": 0, "arr": {"$slice": [1, 2]}, "items": 0}).arr == [20, 30] and one({"arr": {"$slice": -1}}).arr == [40]
    assert one({"items": {"$elemMatch": {"q": 2}}}).asDict(True) == {"_id": 1, "items": [{"n": "b", "q": 2}]}
    assert one({"items": {"$elemMatch": {"q": 9}}})["items"] is None and one({"arr.$": 1}).arr == [10]
    assert one({"items.n": 1}).asDict(True) == {"_id": 1, "items": [{"n": "a"}, {"n": "b"}]} and one({"s": {"$size": "$arr"}}).s == 4
    with pytest.raises(PipelineError):
        one({"arr": 1, "items": 0})


def test_updates(db):
    c = db["c"]
    c.insert([{"_id": 1, "score": 10, "tags": ["a", "b"], "nested": {"x": 1}, "n": 6}])
    one = lambda: c.find_one({"_id": 1}).asDict(True)
    assert c.update({"_id": 1}, {"$inc": {"score": 5}, "$push": {"tags": "c"}, "$set": {"nested.x": 99}}) == {"matched": 1, "modified": 1, "upserted": 0}
    assert one() == {"_id": 1, "score": 15, "tags": ["a", "b", "c"], "nested": {"x": 99}, "n": 6}
    assert c.update({"_id": 1}, {"$set": {"score": 15}})["modified"] == 0 and c.update({"_id": 5}, {"$set": {"score": 1}})["matched"] == 0
    c.update({"_id": 1}, {"$addToSet": {"tags": {"$each": ["x", "a"]}}, "$mul": {"score": 2}, "$min": {"n": 3}, "$max": {"m": 4}, "$bit": {"b": {"or": 5}}})
    assert one() | {"nested": 0} == {"_id": 1, "score": 30, "tags": ["a", "b", "c", "x"], "nested": 0, "n": 3, "m": 4, "b": 5}
    c.update({"_id": 1}, {"$pull": {"tags": {"$gt": "b"}}, "$rename": {"m": "k"}, "$unset": {"nested": ""}})
    assert one()["tags"] == ["a", "b"] and one()["k"] == 4 and one()["m"] is None  # a typed table keeps the column
    c.update({"_id": 1}, {"$push": {"tags": {"$each": ["z", "y"], "$position": 0, "$sort": -1, "$slice": 3}}})
    assert one()["tags"] == ["z", "y", "b"]
    c.update({"_id": 1}, {"$pop": {"tags": -1}})
    c.update({"_id": 1}, {"$pullAll": {"tags": ["b"]}, "$currentDate": {"at": True}})
    assert one()["tags"] == ["y"] and isinstance(one()["at"], dt.datetime)
    assert c.update({"_id": 7, "n": {"$gt": 100}}, {"$set": {"score": 1}, "$setOnInsert": {"n": 2}}, upsert=True)["upserted"] == 1
    assert c.find_one({"_id": 7}).n == 2
    for bad in ({"$inc": {"tags": 1}}, {"$push": {"score": 1}}, {"$nope": {"a": 1}}, {"$set": {"a": 1}, "b": 2}, {"$set": {"tags.$[]": 1}}):
        with pytest.raises(PipelineError):
            c.update({"_id": 1}, bad)


def test_commands(db):
    c = db["people"]
    assert c.insert([{"_id": 1, "name": "alice", "n": 10}, {"_id": 2, "name": "bob", "n": 20}]) == 2
    with pytest.raises(DuplicateKey):
        c.insert([{"_id": 3, "name": "x", "n": 0}, {"_id": 1, "name": "y", "n": 0}])
    assert c.count() == 2
    assert c.bulk_write([{"insertOne": {"document": {"_id": 3, "name": "carol", "n": 1}}}, {"updateOne": {"filter": {"name": "alice"}, "update": {"$inc": {"n": 5}}}}, {"deleteOne": {"filter": {"name": "bob"}}}]) == {
        "inserted": 1, "matched": 1, "modified": 1, "upserted": 0, "deleted": 1,
    }
    old = c.find_and_modify({"n": {"$gt": 0}}, {"$set": {"n": 99}}, sort={"n": -1})
    assert (old.name, old.n) == ("alice", 15) and c.find_and_modify({"name": "alice"}, {"$inc": {"n": 1}}, new=True).n == 100
    assert c.find_and_modify({"name": "alice"}, remove=True, fields={"name": 1}).asDict() == {"_id": 1, "name": "alice"} and c.count() == 1
    c.replace({"_id": 3}, {"name": "cc"})
    assert c.find_one().asDict() == {"_id": 3, "name": "cc", "n": None}
    assert sorted(r.value for r in c.distinct("name").collect()) == ["cc"] and c.distinct("zip").count() == 0
    c.create_index({"name": 1}, unique=True)
    with pytest.raises(DuplicateKey):
        c.insert([{"_id": 9, "name": "cc"}])
    assert [i["name"] for i in c.list_indexes()] == ["_id_", "name_1"]
    c.drop_index("name_1")
    assert [len(b) for b in c.batches(size=1)] == [1]
    db.rename("people", "folk")
    assert db.list_collections() == ["folk"] and db.stats("folk")["count"] == 1
    assert db["folk"].delete({}) == 1 and db["folk"].count() == 0
    db.drop("folk")
    assert db.list_collections() == []
    auto = db["auto"]
    auto.insert([{"x": 1}, {"x": 2}])
    assert len({r._id for r in auto.find().collect()}) == 2


def test_out_and_merge(spark, db):
    table(spark, db, "_id string, val int", [("a", 10), ("b", 20)], "src")
    fill = lambda: db.has("tgt") and db.drop("tgt") or db["tgt"].insert([{"_id": "a", "val": 999, "extra": "keep"}, {"_id": "c", "val": 30, "extra": None}])
    got = lambda: {r._id: (r.val, r.extra) for r in db["tgt"].find().collect()}

    def merge(**o):
        if db.has("tgt"):
            db.drop("tgt")
        db["tgt"].insert([{"_id": "a", "val": 999, "extra": "keep"}, {"_id": "c", "val": 30, "extra": None}])
        db["src"].aggregate([{"$merge": {"into": "tgt", **o}}])
        return got()

    del fill
    assert merge() == {"a": (10, "keep"), "b": (20, None), "c": (30, None)}
    assert merge(whenMatched="replace") == {"a": (10, None), "b": (20, None), "c": (30, None)}
    assert merge(whenMatched="keepExisting", whenNotMatched="discard") == {"a": (999, "keep"), "c": (30, None)}
    for bad in ({"whenMatched": "fail"}, {"whenNotMatched": "fail"}):
        with pytest.raises(Exception, match="merge"):
            merge(**bad)
    assert db["src"].aggregate([{"$out": "copy"}]).count() == 2 and db["copy"].count() == 2


def test_document_mode(spark):
    d = document.documents(spark, ['{"v":42}', '{"v":"hello"}', '{"v":3.14}', '{"v":true}', '{"v":null}', "{}", '{"v":[1,"one"]}', "broken"])
    n = lambda spec: document.match(d.where("doc is not null"), spec).count()
    assert n({"v": {"$type": 2}}) == 1 and n({"v": {"$type": "number"}}) == 2 and n({"v": None}) == 2 and n({"v": {"$exists": True}}) == 6 and n({"v": {"$exists": False}}) == 1
    assert n({"v": {"$in": [1, "one"]}}) == 1 and n({"v": 42.0}) == 1 and n({"v": {"$gt": 5}}) == 1 and n({"v": {"$ne": 42}}) == 6 and n({"$or": [{"v": "hello"}, {"v": True}]}) == 2 and n({"v": {"$size": 2}}) == 1
    order = document.sort(d.where("doc is not null"), {"v": 1}).select(document.type_of(document.at("v")).alias("t"))
    assert [r.t for r in order.collect()][2:] == ["double", "int", "string", "array", "bool"]
    g = document.group_count(document.documents(spark, ['{"v":1}', '{"v":1.0}', '{"v":"1"}', '{"v":null}', "{}"]), "v")
    assert sorted(r["count"] for r in g.collect()) == [1, 2, 2]


def test_streaming(spark, tmp_path):
    from tarn.streaming.pipelines import session_group, stream_pipeline, windowed_group

    src = str(tmp_path / "in")
    t = dt.datetime(2024, 1, 1)
    base = spark.createDataFrame([(i, t + dt.timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(20)], "id long, ts timestamp, kind string, v double")
    base.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(base.schema).parquet(src)

    def results(df, name, mode="append"):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    rows_ = results(stream_pipeline(stream, [{"$match": {"v": {"$gte": 10}}}, {"$project": {"id": 1, "w": {"$multiply": ["$v", 2]}}}]), "rowwise")
    assert rows_.count() == 10 and rows_.where("w = 20.0").count() == 1
    g = results(windowed_group(stream, "ts", {"_id": "$kind", "n": {"$sum": 1}}, "1 hour"), "grouped", "complete")
    assert g.agg(F.sum("n")).first()[0] == 20
    s = results(session_group(stream, "ts", ["kind"], "10 minutes"), "sessioned")
    assert s.count() >= 10
    with pytest.raises(PipelineError):
        stream_pipeline(stream, [{"$group": {"_id": None}}])


def test_schema_free_frame(spark):
    f = run(Frame(spark.createDataFrame([(1,)], "x int")), [{"$set": {"a.b.c": "$x"}}])
    assert f.df.schema == T.StructType([T.StructField("x", T.IntegerType()), *f.df.schema.fields[1:]]) and f.df.first().a.b.c == 1
    assert compile_match({}, f.schema) is not None


@pytest.mark.parametrize("rx", ["[aeiou]", "^a", "(b)(c)?", "x*", "(?=b)", "$", "🙂", "b+", "(?<=a)b"])
def test_regex_finds_match_a_plain_scan(spark, rx):
    """Matches, places in characters and groups; the patterns mean the same in either dialect."""
    texts = ["abcab", "", "🙂ab🙂cbb", "xxx", "bcb", None, "no"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    db = Database(spark, "/nowhere", {"c": df})
    rows = db["c"].aggregate([{"$project": {"s": 1, "one": {"$regexFind": {"input": "$s", "regex": rx}}, "all": {"$regexFindAll": {"input": "$s", "regex": rx}}}}]).collect()
    for r in rows:
        if rx == "x*" and r.s and "🙂" in r.s:
            continue  # the JVM also has empty matches between the two halves of such a character
        want = [] if r.s is None else [(m.group(0), m.start(), [g or None for g in m.groups()]) for m in re.finditer(rx, r.s)]
        assert [tuple(x) for x in r["all"]] == want, r.s
        assert (None if r.one is None else tuple(r.one)) == (want[0] if want else None), r.s


def test_lookup_forms(spark, db):
    table(spark, db, "_id int, k array<string>, n int", [(1, ["x", "y"], 1), (2, ["x"], 2), (3, [], 3), (4, None, 4), (5, ["z", None], 5)], "l")
    table(spark, db, "_id int, k array<string>, v int", [(10, ["x", "y"], 5), (11, ["x"], 7), (12, None, 1), (13, ["q"], 3)], "f")
    table(spark, db, "_id int, g string, v int, tag string", [(1, "x", 5, "a"), (2, "x", 9, "b"), (3, "x", 7, "a"), (4, "y", 1, "c"), (5, None, 2, "d")], "s")
    look = lambda frm, **o: {"$lookup": {"from": frm, "localField": "k", "foreignField": o.pop("ff", "k"), "as": "m", **o}}
    run = lambda c, *stages: {r._id: r for r in db[c].aggregate(list(stages)).collect()}
    got = run("l", look("f"))
    assert {i: sorted(x._id for x in r.m) for i, r in got.items()} == {1: [10, 11], 2: [10, 11], 3: [], 4: [], 5: [12]}
    assert set(run("l", look("f"), {"$match": {"m": []}})) == {3, 4}
    assert set(run("l", look("s", ff="g"), {"$match": {"m": {"$ne": []}}}, {"$unset": "m"})) == {1, 2, 5}
    assert set(run("l", look("s", ff="g"), {"$match": {"m": {"$size": 0}}})) == {3, 4}
    # the best two of each row's matches, whatever number of keys it has
    top = [{"$sort": {"v": -1}}, {"$limit": 2}, {"$project": {"v": 1, "_id": 0}}]
    got = run("l", look("s", ff="g", pipeline=top))
    assert {i: [x.v for x in r.m] for i, r in got.items()} == {1: [9, 7], 2: [9, 7], 3: [], 4: [], 5: [2]}
    # per key, before the join
    table(spark, db, "_id string", [("x",), ("y",), ("w",)], "keys")
    by_key = lambda p: {"$lookup": {"from": "s", "localField": "_id", "foreignField": "g", "pipeline": p, "as": "m"}}
    got = run("keys", by_key([{"$sort": {"v": 1}}, {"$skip": 1}, {"$project": {"v": 1, "_id": 0}}]))
    assert {i: [x.v for x in r.m] for i, r in got.items()} == {"x": [7, 9], "y": [], "w": []}
    got = run("keys", by_key([{"$group": {"_id": "$tag", "n": {"$sum": 1}, "top": {"$max": "$v"}}}, {"$sort": {"_id": 1}}]))
    assert {i: [tuple(x) for x in r.m] for i, r in got.items()} == {"x": [("a", 2, 7), ("b", 1, 9)], "y": [("c", 1, 1)], "w": []}
    got = run("keys", by_key([{"$sortByCount": "$tag"}]))
    assert [tuple(x) for x in got["x"].m] == [("a", 2), ("b", 1)]
    got = run("keys", by_key([{"$match": {"v": {"$gt": 5}}}, {"$count": "n"}]))
    assert {i: [x.n for x in r.m] for i, r in got.items()} == {"x": [2], "y": [], "w": []}
    let = {"$lookup": {"from": "s", "let": {"k": "$_id"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$g", "$$k"]}}}, {"$sort": {"v": -1}}, {"$limit": 1}, {"$replaceRoot": {"newRoot": {"best": "$v"}}}], "as": "m"}}
    assert {i: [x.best for x in r.m] for i, r in run("keys", let).items()} == {"x": [9], "y": [1], "w": []}
    got = run("keys", {**let}, {"$unwind": "$m"})
    assert {i: r.m.best for i, r in got.items()} == {"x": 9, "y": 1}


def test_first_and_last_with_mixed_directions(spark, db):
    rows = [(g, a, b, t, i) for i, (g, a, b, t) in enumerate([("p", 1, 2.0, "b"), ("p", 1, None, "a"), ("p", None, 5.0, "c"), ("p", 2, float("nan"), "d"), ("q", None, None, None), ("p", 2, 7.0, "e")])]
    c = table(spark, db, "g string, a int, b double, t string, i int", rows, "fl")
    for spec in ({"a": 1, "b": -1}, {"b": -1, "a": 1}, {"a": -1, "t": 1}, {"t": -1, "a": 1}):
        got = {r._id: r for r in c.aggregate([{"$sort": spec}, {"$group": {"_id": "$g", "f": {"$first": "$i"}, "l": {"$last": "$i"}, "all": {"$push": "$i"}}}]).collect()}
        assert all(r.f == r["all"][0] and r.l == r["all"][-1] for r in got.values()), spec
    plan = c.aggregate([{"$sort": {"a": 1, "b": -1}}, {"$group": {"_id": "$g", "f": {"$first": "$i"}}}])._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_positional_projection_follows_the_query(spark, db):
    c = table(spark, db, "_id int, a array<int>, d array<struct<k:string,v:int>>", [(1, [1, 5, 9], [("x", 1), ("y", 2)]), (2, [7, 8], [("y", 3), ("y", 4)])], "pp")
    assert [r.a for r in c.find({"a": {"$gt": 4}}, {"a.$": 1}, sort={"_id": 1}).collect()] == [[5], [7]]
    assert [[tuple(x) for x in r.d] for r in c.find({"d.k": "y"}, {"d.$": 1}, sort={"_id": 1}).collect()] == [[("y", 2)], [("y", 3)]]
    assert [[tuple(x) for x in r.d] for r in c.find({"d": {"$elemMatch": {"k": "y", "v": {"$gt": 3}}}}, {"d.$": 1}).collect()] == [[("y", 4)]]
    assert c.find({"_id": 1}, {"a.$": 1}).first().a == [1]


def test_merge_of_repeated_keys(spark, db):
    table(spark, db, "_id int, v int", [(1, 0), (2, 0)], "mt")
    src = table(spark, db, "k int, v int, at int", [(1, 5, 2), (1, 6, 1), (3, 7, 1), (3, 8, 2), (None, 9, 1)], "ms")
    for how, want in (("merge", {(1, 5), (2, 0), (3, 8), (None, 9)}), ("keepExisting", {(1, 0), (2, 0), (3, 7), (None, 9)})):
        db.write("mt2", db.load("mt"))
        src.aggregate([{"$sort": {"at": 1}}, {"$project": {"_id": "$k", "v": 1, "at": 1}}, {"$merge": {"into": "mt2", "whenMatched": how}}])
        assert {(r._id, r.v) for r in db["mt2"].find().collect()} == want
    with pytest.raises(Exception, match="matches"):
        src.aggregate([{"$project": {"_id": {"$add": ["$k", 90]}, "v": 1}}, {"$merge": {"into": "mt2", "whenMatched": "fail"}}])


def test_two_handles_share_indexes_and_never_lose_a_change(spark, tmp_path):
    a, b = (Database(spark, str(tmp_path / "db")) for _ in range(2))
    a["c"].insert([{"_id": 1, "u": "x"}])
    a["c"].create_index({"u": 1}, unique=True)
    with pytest.raises(DuplicateKey):
        b["c"].insert([{"_id": 2, "u": "x"}])
    assert [i["name"] for i in b["c"].list_indexes()] == ["_id_", "u_1"]
    before, read = b.state("c"), b["c"].find()
    a["c"].insert([{"_id": 2, "u": "y"}])
    with pytest.raises(WriteConflict):  # computed from a version that is no longer the current one
        b.write("c", b.load("c").where("_id = 1"), before)
    assert b["c"].count() == 2 and read.count() == 1  # a reader keeps its version
    a["c"].update({"_id": 2}, {"$set": {"u": "z"}})
    assert read.count() == 1 and {r.u for r in b["c"].find().collect()} == {"x", "z"}
    with pytest.raises(DuplicateKey):
        b["c"].update({"_id": 2}, {"$set": {"u": "x"}})
    b["c"].drop_index("*")
    assert a["c"].update({"_id": 2}, {"$set": {"u": "x"}})["modified"] == 1
    assert a.validate("c") == {"ns": "c", "valid": True, "nrecords": 2, "nIndexes": 1, "errors": []}
    assert [d["name"] for d in list_databases(spark, str(tmp_path))] == ["db"]


def test_ordered_and_unordered_inserts(spark, db):
    batch = [{"_id": 5, "v": 1}, {"_id": 1, "v": 2}, {"_id": 6, "v": 3}, {"_id": 6, "v": 4}, {"_id": 7, "v": None, "w": {"a": [1, 2.5]}, "t": dt.datetime(2031, 1, 1)}]
    for ordered, want in ((None, {1}), (True, {1, 5}), (False, {1, 5, 6, 7})):
        c = db[f"i{ordered}"]
        c.insert([{"_id": 1, "v": 0}])
        with pytest.raises(DuplicateKey) as e:
            c.insert(batch, ordered=ordered)
        assert {r._id for r in c.find().collect()} == want and e.value.inserted == len(want) - 1
    assert db["iFalse"].find_one({"_id": 6}).v == 3
    row = db["iFalse"].find_one({"_id": 7})
    assert row.v is None and row.w.a == [1.0, 2.5] and row.t == dt.datetime(2031, 1, 1)
    assert len(db.state("iFalse")["parts"]) == 2 and db["iFalse"].insert(spark.range(20, 25).selectExpr("cast(id as int) as _id", "1 as v")) == 5
    assert len(db.state("iFalse")["parts"]) == 3  # the rows there before were not written again
    db["iFalse"].insert([{"_id": 90, "v": 2.5}])  # a wider type is written through
    assert dict(db["iFalse"].df.dtypes)["v"] == "double" and db["iFalse"].count() == 10


def test_cursors_by_id(spark, db):
    c = db["cur"]
    c.insert([{"_id": i} for i in range(7)])
    number, first = c.cursor(3, sort={"_id": 1})
    again, second = db.get_more(number)
    last, third = db.get_more(again)
    assert [r._id for r in first + second + third] == list(range(7)) and number and last == 0
    other, _ = c.cursor(2)
    assert db.kill_cursors(other, 123) == [other]
    for gone in (number, other):
        with pytest.raises(PipelineError, match="cursor"):
            db.get_more(gone)
    assert c.cursor(10)[0] == 0


def test_cursors_have_any_number_of_batches(spark, db):
    db.tables["many"] = spark.range(3000)
    number, rows = db["many"].cursor(1, sort={"id": 1})
    seen = [rows]
    while number:
        number, rows = db.get_more(number)
        seen.append(rows)
    assert [[r.id for r in b] for b in seen] == [[i] for i in range(3000)] and not db.cursors


def test_a_cursor_that_fails_does_not_end_as_if_all_were_read(db):
    def broken():
        yield [1]
        yield [2]
        raise ValueError("lost")

    number, first = db.open_cursor(broken())
    assert number and first == [1]
    with pytest.raises(ValueError, match="lost"):
        db.get_more(number)
    with pytest.raises(PipelineError, match="no cursor"):
        db.get_more(number)


def test_reindex_lays_rows_out_and_for_each_sees_all(spark, db, tmp_path):
    c = db["lay"]
    c.insert(spark.range(1000).selectExpr("id as _id", "cast((id * 7919) % 1000 as int) as k"))
    c.create_index({"k": 1})
    c.reindex("k_1")
    lows = [r.k for r in c.df.select("k").collect()]
    assert lows == sorted(lows) and c.count({"k": 5}) == 1
    seen = tmp_path / "seen"
    seen.mkdir()
    folder = str(seen)
    c.for_each(lambda r: open(f"{folder}/{r._id}", "w").close(), {"k": {"$lt": 10}})
    assert len(list(seen.iterdir())) == 10
    with pytest.raises(PipelineError, match="no index"):
        c.reindex("none")


def test_document_filters_and_stages(spark):
    texts = [
        '{"i":1,"a":[1,5,9],"s":"Hello","d":[{"k":"x","n":3},{"k":"y","n":8}],"o":{"p":6}}',
        '{"i":2,"a":7,"s":["abc","Hey"],"d":{"k":"y","n":1},"o":{"p":6.0}}',
        '{"i":3,"a":[],"s":null,"o":{"p":"6"}}',
        '{"i":4,"o":{}}',
    ]
    d = document.documents(spark, texts)
    hit = lambda spec: {r.i for r in document.project(document.match(d, spec), {"i": "i:int"}).collect()}
    assert hit({"a": {"$gt": 6}}) == {1, 2} and hit({"a": {"$all": [1, 9]}}) == {1} and hit({"a": {"$mod": [4, 1]}}) == {1}
    assert hit({"s": {"$regex": "^he", "$options": "i"}}) == {1, 2} and hit({"s": re.compile("^he")}) == set() and hit({"s": {"$in": [re.compile("llo")]}}) == {1}
    assert hit({"d.k": "y"}) == {1, 2} and hit({"d.n": {"$lt": 2}}) == {2} and hit({"d": {"$elemMatch": {"k": "x", "n": {"$gt": 2}}}}) == {1}
    assert hit({"a": {"$elemMatch": {"$gt": 5, "$lt": 9}}}) == set() and hit({"a": {"$elemMatch": {"$gte": 5, "$lt": 9}}}) == {1}
    assert hit({"o.p": 6}) == {1, 2} and hit({"o": {"p": 6}}) == {1, 2} and hit({"a": {"$not": {"$size": 0}}}) == {1, 2, 4} and hit({"a": {"$bitsAllSet": 5}}) == {1, 2}
    assert hit({"d.k": {"$ne": "y"}}) == {3, 4} and hit({"$expr": {"$gt": ["$o.p", "$i"]}}) == {1, 2, 3} and hit({"$expr": {"$and": [{"$eq": ["$o.p", 6]}, {"$not": [{"$lt": ["$i", 2]}]}]}}) == {2}
    for bad in ({"a": {"$where": "x"}}, {"$text": "x"}, {"a": {"$mod": [0, 1]}}, {"$expr": {"$add": [1, 2]}}):
        with pytest.raises(PipelineError):
            document.match(d, bad)
    got = document.aggregate(d, [{"$group": {"_id": "$o.p", "n": {"$sum": 1}, "total": {"$sum": "$i"}, "mean": {"$avg": "$a"}, "top": {"$max": "$i"}, "all": {"$push": "$i"}}}])
    rows = {(r.n, r.total, r.mean, str(r.top.toPython()), len(r["all"])) for r in got.collect()}
    assert rows == {(2, 3.0, 7.0, "2", 2), (1, 3.0, None, "3", 1), (1, 4.0, None, "4", 1)}
    one = document.aggregate(d, [{"$unwind": "$d"}, {"$project": {"k": "$d.k", "i": "$_doc.i", "c": {"$literal": 5}}}, {"$sort": {"i": 1, "k": -1}}, {"$skip": 1}, {"$limit": 2}])
    assert [r.doc.toPython() for r in one.collect()] == [{"k": "x", "i": 1, "c": 5}, {"k": "y", "i": 2, "c": 5}]
    assert document.aggregate(d, [{"$match": {"i": {"$gt": 1}}}, {"$count": "n"}]).first().n == 3
    assert document.aggregate(d, [{"$sortByCount": "$nothing"}]).first()["count"] == 4
    assert document.aggregate(d.limit(0), [{"$group": {"_id": None, "n": {"$sum": 1}}}]).count() == 0


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "jsonl", "csv"])
def test_files_of_every_format_are_collections(spark, tmp_path, kind):
    from tarn.sources import read_files, write_files

    df = spark.createDataFrame([(1, "a,b", 2.5), (2, None, -1.0), (3, "ü\"x", None)], "id int, s string, x double")
    write_files(df, f"{tmp_path}/t.{kind}")
    back = read_files(spark, f"{tmp_path}/t.{kind}", schema="id int, s string, x double")
    assert sorted(back.collect()) == sorted(df.collect())
    db = Database(spark, str(tmp_path))
    assert db.list_collections() == ["t"] and db["t"].count() == 3
    with pytest.raises(ValueError, match="format"):
        read_files(spark, f"{tmp_path}/t.xyz")


def test_executors_get_the_package(tmp_path):
    """With the package on the driver's path alone, workers import it from the archive."""
    import subprocess
    import sys
    import textwrap

    code = f"""
        import sys
        sys.path.insert(0, {str(__import__("pathlib").Path(document.__file__).parent.parent)!r})
        from tarn.session import session
        spark = session("ship", "local[1]", 1)
        def where(rows):
            import tarn
            yield tarn.__file__
        print("FOUND", spark.sparkContext.parallelize([1], 1).mapPartitions(where).collect())
    """
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=300)
    assert "FOUND" in out.stdout and ".zip/tarn" in out.stdout, out.stderr[-800:]
