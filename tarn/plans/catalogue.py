"""Registered pipelines over the star schema, each with its SQL counterpart.

Results end in scalars: nested values are joined or measured, dates are written
as text or milliseconds, and sums of floating numbers are rounded.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn import document
from tarn.database import Database, DuplicateKey
from tarn.sources import cut_lineage, read_table, scratch_folder
from tarn.streaming.pipelines import stream_pipeline, windowed_group

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "accounts", "audit_events", "compat_reports")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables(Database):
    """The parquet tables of a folder as read-only collections."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark, folder)

    def load(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else read_table(self.spark, self.root, name)

    def has(self, name: str) -> bool:
        return name in TABLES or name in self.tables


def pipeline(name: str, collection: str, stages: list[dict[str, Any]], sql: str | None = None) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return Tables(spark, d)[collection].aggregate(stages)

    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def find(name: str, collection: str, sql: str, **options: Any) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return Tables(spark, d)[collection].find(**options)

    QUERIES[name] = query
    ORACLE[name] = sql


def project(name: str, collection: str, key: str, exprs: dict[str, tuple[Any, str]], where: dict | None = None, sql_where: str = "") -> None:
    """Expressions over every row of a table, one column each."""
    stages: list[dict] = [{"$match": where}] if where else []
    stages.append({"$project": {key: 1, **{k: e for k, (e, _) in exprs.items()}}})
    cols = ", ".join(f"{sql} AS {k}" for k, (_, sql) in exprs.items())
    pipeline(name, collection, stages, f"SELECT {key}, {cols} FROM {collection} {sql_where}")


D = dt.datetime
R = lambda x, n=2: {"$round": [x, n]}

# ---- flagship and multi-join ---------------------------------------------------------------------------------------

pipeline(
    "flagship_pricing_summary",
    "lineitem",
    [
        {"$match": {"l_shipdate": {"$lte": D(1998, 9, 2)}}},
        {
            "$group": {
                "_id": {"rf": "$l_returnflag", "ls": "$l_linestatus"},
                "sum_qty": {"$sum": "$l_quantity"},
                "sum_price": {"$sum": "$l_extendedprice"},
                "sum_disc": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}},
                "avg_disc": {"$avg": "$l_discount"},
                "n": {"$sum": 1},
            }
        },
        {"$project": {"_id": 0, "rf": "$_id.rf", "ls": "$_id.ls", "sum_qty": R("$sum_qty"), "sum_price": R("$sum_price"), "sum_disc": R("$sum_disc", 1), "avg_disc": R("$avg_disc", 6), "n": 1}},
        {"$sort": {"rf": 1, "ls": 1}},
    ],
    """SELECT l_returnflag AS rf, l_linestatus AS ls, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
round(sum(l_extendedprice * (1 - l_discount)), 1) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY 1, 2""",
)
pipeline(
    "join_customer_orders_nation",
    "customer",
    [
        {"$match": {"c_mktsegment": "BUILDING"}},
        {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}},
        {"$unwind": "$o"},
        {"$lookup": {"from": "nation", "localField": "c_nationkey", "foreignField": "n_nationkey", "as": "n"}},
        {"$unwind": "$n"},
        {"$group": {"_id": "$n.n_name", "orders": {"$sum": 1}, "total": {"$sum": "$o.o_totalprice"}}},
        {"$project": {"_id": 0, "nation": "$_id", "orders": 1, "total": R("$total", 1)}},
    ],
    """SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 1) AS total FROM customer JOIN orders ON o_custkey = c_custkey
JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name""",
)
pipeline(
    "join_shipping_priority",
    "lineitem",
    [
        {"$match": {"l_shipdate": {"$gt": D(1998, 3, 15)}}},
        {"$lookup": {"from": "orders", "localField": "l_orderkey", "foreignField": "o_orderkey", "as": "o"}},
        {"$unwind": "$o"},
        {"$match": {"o.o_orderdate": {"$lt": D(1998, 3, 15)}}},
        {"$group": {"_id": "$l_orderkey", "revenue": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}}},
        {"$project": {"_id": 0, "orderkey": "$_id", "revenue": R("$revenue")}},
        {"$sort": {"revenue": -1, "orderkey": 1}},
        {"$limit": 10},
    ],
    """SELECT l_orderkey AS orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_shipdate > TIMESTAMP '1998-03-15' AND o_orderdate < TIMESTAMP '1998-03-15' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)

# ---- filters -------------------------------------------------------------------------------------------------------


def matched(name: str, collection: str, key: str, spec: dict, where: str) -> None:
    pipeline(name, collection, [{"$match": spec}, {"$project": {key: 1}}], f"SELECT {key} FROM {collection} WHERE {where}")


matched("match_eq", "orders", "o_orderkey", {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
matched("match_ne", "orders", "o_orderkey", {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus IS DISTINCT FROM 'F'")
matched("match_in", "orders", "o_orderkey", {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')")
matched("match_nin", "accounts", "account_id", {"dept": {"$nin": ["research", "support"]}}, "dept IS NULL OR dept NOT IN ('research', 'support')")
matched("match_in_null", "accounts", "account_id", {"dept": {"$in": ["research", None]}}, "dept IS NULL OR dept = 'research'")
matched("match_range", "lineitem", "l_orderkey", {"l_quantity": {"$gte": 10, "$lt": 20}, "l_discount": {"$gt": 0.05, "$lte": 0.08}}, "l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05::DOUBLE AND l_discount <= 0.08::DOUBLE")
matched(
    "match_logic",
    "orders",
    "o_orderkey",
    {"$or": [{"o_orderstatus": "P"}, {"$and": [{"o_totalprice": {"$gt": 300000}}, {"o_orderpriority": "5-LOW"}]}], "$nor": [{"o_custkey": {"$lt": 100}}]},
    "(o_orderstatus = 'P' OR (o_totalprice > 300000 AND o_orderpriority = '5-LOW')) AND NOT o_custkey < 100",
)
matched("match_not", "accounts", "account_id", {"score": {"$not": {"$gt": 50}}}, "NOT coalesce(score > 50, false)")
matched("match_regex", "part", "p_partkey", {"p_name": {"$regex": "^red"}}, "p_name LIKE 'red%'")
matched("match_regex_options", "part", "p_partkey", {"p_name": {"$regex": "WIDGET$", "$options": "i"}}, "regexp_matches(p_name, '(?i)WIDGET$')")
matched("match_mod", "orders", "o_orderkey", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3")
matched(
    "match_bits",
    "orders",
    "o_orderkey",
    {"o_orderkey": {"$bitsAllSet": 5, "$bitsAnySet": [1, 3], "$bitsAllClear": 64, "$bitsAnyClear": [4, 5]}},
    "(o_orderkey & 5) = 5 AND (o_orderkey & 10) <> 0 AND (o_orderkey & 64) = 0 AND (o_orderkey & 48) <> 48",
)
matched("match_exists", "accounts", "account_id", {"score": {"$exists": True}, "dept": {"$exists": False}}, "score IS NOT NULL AND dept IS NULL")
matched("match_type", "accounts", "account_id", {"score": {"$type": "int"}, "tags": {"$type": 4}}, "score IS NOT NULL AND tags IS NOT NULL")
matched("match_expr", "lineitem", "l_orderkey", {"$expr": {"$gt": [{"$multiply": ["$l_quantity", 1000]}, "$l_extendedprice"]}}, "l_quantity * 1000 > l_extendedprice")
matched("match_text", "documents", "doc_id", {"$text": {"$search": "Conjecture"}}, "contains(lower(text), 'conjecture') OR contains(lower(coalesce(lang, '')), 'conjecture') OR contains(lower(coalesce(source, '')), 'conjecture') OR contains(lower(coalesce(paper_key, '')), 'conjecture') OR contains(lower(coalesce(submitter, '')), 'conjecture')")
matched("match_null", "accounts", "account_id", {"score": None}, "score IS NULL")
matched("match_nested", "accounts", "account_id", {"profile.age": {"$gte": 40}, "profile.city": "Osthaven"}, "profile.age >= 40 AND profile.city = 'Osthaven'")
matched("match_array_any", "accounts", "account_id", {"tags": "night"}, "coalesce(list_contains(tags, 'night'), false)")
matched("match_size", "accounts", "account_id", {"tags": {"$size": 2}}, "len(tags) = 2")
matched("match_all", "accounts", "account_id", {"tags": {"$all": ["lab", "night"]}}, "list_contains(tags, 'lab') AND list_contains(tags, 'night')")
matched("match_elem", "embeddings", "vec_id", {"embedding": {"$elemMatch": {"$gt": 0.3, "$lt": 0.35}}}, "len(list_filter(embedding, lambda x: x::DOUBLE > 0.3::DOUBLE AND x::DOUBLE < 0.35::DOUBLE)) > 0")
matched(
    "match_elem_document", "compat_reports", "report_id",
    {"results": {"$elemMatch": {"status": "fail", "category": "Text"}}},
    "len(list_filter(results, lambda r: r.status = 'fail' AND r.category = 'Text')) > 0",
)
matched("match_position", "embeddings", "vec_id", {"embedding.0": {"$gt": 0.0}}, "embedding[1] > 0")


def _unbracketed(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d)["accounts"].find({"score": {"$lt": 30}}, {"account_id": 1}, bracketing=False)


QUERIES["match_unbracketed"] = _unbracketed
ORACLE["match_unbracketed"] = "SELECT account_id FROM accounts WHERE score < 30 OR score IS NULL"

# ---- find ----------------------------------------------------------------------------------------------------------

find("find_sort_limit", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", filter={"o_orderstatus": "O"}, projection={"o_orderkey": 1, "o_totalprice": 1}, sort={"o_totalprice": -1, "o_orderkey": 1}, limit=20)
find("find_skip", "customer", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 25", projection={"c_custkey": 1}, sort={"c_acctbal": 1, "c_custkey": 1}, skip=25, limit=10)
find("find_exclusion", "nation", "SELECT n_nationkey, n_name FROM nation", projection={"n_regionkey": 0})
def _sliced(spark: SparkSession, d: str) -> DataFrame:
    base = Tables(spark, d)["accounts"].find({"tags": {"$exists": True}}, {"account_id": 1, "city": "$profile.city", "tags": {"$slice": 2}})
    return base.withColumn("tags", F.array_join("tags", ","))


QUERIES["find_nested_slice"] = _sliced
ORACLE["find_nested_slice"] = "SELECT account_id, profile.city AS city, array_to_string(tags[1:2], ',') AS tags FROM accounts WHERE tags IS NOT NULL"


def _elem_projection(spark: SparkSession, d: str) -> DataFrame:
    base = Tables(spark, d)["compat_reports"].find({"results": {"$exists": True}}, {"report_id": 1, "received_at": 1, "results": {"$elemMatch": {"status": "fail"}}})
    return base.select("report_id", F.unix_micros("received_at").alias("at"), F.get("results", F.lit(0)).getField("name").alias("name"))


QUERIES["find_elem_match"] = _elem_projection
ORACLE["find_elem_match"] = "SELECT report_id, epoch_us(received_at) AS at, list_filter(results, lambda r: r.status = 'fail')[1].name AS name FROM compat_reports WHERE results IS NOT NULL"


def _distinct(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d)["customer"].distinct("c_mktsegment", {"c_acctbal": {"$gt": 0}})


QUERIES["distinct_field"] = _distinct
ORACLE["distinct_field"] = "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_acctbal > 0"


def _count_filter(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(Tables(spark, d)["events"].count({"event_type": "click"}),)], "n long")


QUERIES["count_filter"] = _count_filter
ORACLE["count_filter"] = "SELECT count(*) AS n FROM events WHERE event_type = 'click'"

# ---- rows ----------------------------------------------------------------------------------------------------------

pipeline("project_inclusion", "accounts", [{"$project": {"account_id": 1, "profile.city": 1}}, {"$project": {"account_id": 1, "city": "$profile.city"}}], "SELECT account_id, profile.city AS city FROM accounts")
pipeline("project_exclusion", "supplier", [{"$project": {"s_acctbal": 0, "s_name": 0}}], "SELECT s_suppkey, s_nationkey FROM supplier")
pipeline("add_fields", "orders", [{"$addFields": {"o_totalprice": {"$divide": ["$o_totalprice", 2]}, "was": "$o_totalprice"}}, {"$project": {"o_orderkey": 1, "o_totalprice": 1, "was": 1}}], "SELECT o_orderkey, o_totalprice / 2 AS o_totalprice, o_totalprice AS was FROM orders")
pipeline("set_nested", "accounts", [{"$set": {"profile.age": 1, "profile.code": "$account_id"}}, {"$project": {"account_id": 1, "a": "$profile.age", "c": "$profile.code", "city": "$profile.city"}}], "SELECT account_id, 1 AS a, account_id AS c, profile.city AS city FROM accounts")
pipeline("unset_fields", "accounts", [{"$unset": ["tags", "profile.age", "created_at", "status", "username", "dept", "score"]}, {"$project": {"account_id": 1, "city": "$profile.city"}}], "SELECT account_id, profile.city AS city FROM accounts")
pipeline("replace_root", "customer", [{"$replaceRoot": {"newRoot": {"key": "$c_custkey", "segment": "$c_mktsegment"}}}], "SELECT c_custkey AS key, c_mktsegment AS segment FROM customer")
pipeline("replace_with", "orders", [{"$replaceWith": {"$mergeObjects": [{"k": "$o_orderkey", "p": "none"}, {"p": "$o_orderpriority"}]}}], "SELECT o_orderkey AS k, o_orderpriority AS p FROM orders")
pipeline(
    "redact", "accounts",
    [{"$redact": {"$cond": [{"$gt": ["$score", 90]}, "$$PRUNE", {"$cond": [{"$gt": ["$age", 50]}, "$$PRUNE", "$$DESCEND"]}]}}, {"$project": {"account_id": 1, "city": "$profile.city"}}],
    "SELECT account_id, CASE WHEN profile.age > 50 THEN NULL ELSE profile.city END AS city FROM accounts WHERE NOT coalesce(score > 90, false)",
)
pipeline("sort_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 15}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
pipeline("sort_skip_limit", "part", [{"$sort": {"p_retailprice": 1, "p_partkey": 1}}, {"$skip": 100}, {"$limit": 20}, {"$project": {"p_partkey": 1}}], "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 20 OFFSET 100")
pipeline("count_stage", "lineitem", [{"$match": {"l_tax": {"$gt": 0.05}}}, {"$count": "n"}], "SELECT CAST(count(*) AS INTEGER) AS n FROM lineitem WHERE l_tax > 0.05::DOUBLE")
pipeline("count_empty", "lineitem", [{"$match": {"l_tax": {"$gt": 5}}}, {"$count": "n"}], "SELECT CAST(0 AS INTEGER) AS n")
pipeline("sort_by_count", "part", [{"$sortByCount": "$p_brand"}, {"$project": {"_id": 0, "brand": "$_id", "count": 1}}], "SELECT p_brand AS brand, CAST(count(*) AS INTEGER) AS count FROM part GROUP BY 1")
pipeline("sample_size", "orders", [{"$sample": {"size": 50}}, {"$count": "n"}], "SELECT CAST(50 AS INTEGER) AS n")

# ---- groups --------------------------------------------------------------------------------------------------------

pipeline(
    "group_basic", "orders",
    [{"$group": {"_id": "$o_orderstatus", "total": {"$sum": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}, "least": {"$min": "$o_totalprice"}, "most": {"$max": "$o_totalprice"}, "n": {"$count": {}}}},
     {"$project": {"_id": 0, "status": "$_id", "total": R("$total", 1), "mean": R("$mean"), "least": 1, "most": 1, "n": 1}}],
    "SELECT o_orderstatus AS status, round(sum(o_totalprice), 1) AS total, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1",
)
pipeline("group_all", "accounts", [{"$group": {"_id": None, "total": {"$sum": "$score"}, "mean": {"$avg": "$score"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "total": 1, "mean": R("$mean", 6), "n": 1}}], "SELECT CAST(coalesce(sum(score), 0) AS BIGINT) AS total, round(avg(score), 6) AS mean, count(*) AS n FROM accounts")
pipeline("group_compound_key", "lineitem", [{"$group": {"_id": {"flag": "$l_returnflag", "year": {"$year": "$l_shipdate"}}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "flag": "$_id.flag", "year": "$_id.year", "n": 1}}], "SELECT l_returnflag AS flag, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY ALL")
pipeline("group_null_key", "accounts", [{"$group": {"_id": "$dept", "n": {"$sum": 1}, "scored": {"$sum": {"$cond": [{"$gte": ["$score", 0]}, 1, 0]}}}}, {"$project": {"_id": 0, "dept": "$_id", "n": 1, "scored": 1}}], "SELECT dept, count(*) AS n, CAST(count(score) AS BIGINT) AS scored FROM accounts GROUP BY dept")
pipeline("group_std_dev", "events", [{"$group": {"_id": "$event_type", "pop": {"$stdDevPop": "$value"}, "samp": {"$stdDevSamp": "$value"}}}, {"$project": {"_id": 0, "type": "$_id", "pop": R("$pop", 6), "samp": R("$samp", 6)}}], "SELECT event_type AS type, round(stddev_pop(value), 6) AS pop, round(stddev_samp(value), 6) AS samp FROM events GROUP BY 1")
pipeline("group_first_last", "orders", [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}, {"$project": {"_id": 0, "cust": "$_id", "first": 1, "last": 1}}], "SELECT o_custkey AS cust, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1")
pipeline(
    "group_push_sorted", "orders",
    [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "all": {"$push": "$o_orderkey"}}},
     {"$project": {"_id": 0, "cust": "$_id", "n": {"$size": "$all"}, "top": {"$arrayElemAt": ["$all", 0]}, "text": {"$reduce": {"input": {"$slice": ["$all", 3]}, "initialValue": "", "in": {"$concat": ["$$value", {"$toString": "$$this"}, ";"]}}}}}],
    "SELECT o_custkey AS cust, CAST(count(*) AS INTEGER) AS n, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1] AS top, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3], ';') || ';' AS text FROM orders GROUP BY 1",
)
pipeline("group_add_to_set", "orders", [{"$group": {"_id": "$o_custkey", "set": {"$addToSet": "$o_orderpriority"}}}, {"$project": {"_id": 0, "cust": "$_id", "n": {"$size": "$set"}}}], "SELECT o_custkey AS cust, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS n FROM orders GROUP BY 1")
pipeline("bucket_price", "part", [{"$bucket": {"groupBy": "$p_retailprice", "boundaries": [0, 900, 950, 1000, 5000, 9000], "default": -1, "output": {"mean": {"$avg": "$p_size"}}}}, {"$project": {"_id": 0, "lo": "$_id", "count": 1, "mean": R("$mean", 6)}}],
    """WITH b AS (SELECT unnest([0, 900, 950, 1000, 5000]) AS lo, unnest([900, 950, 1000, 5000, 9000]) AS hi)
SELECT lo, CAST(count(p_partkey) AS INTEGER) AS count, round(avg(p_size), 6) AS mean FROM b LEFT JOIN part ON p_retailprice >= lo AND p_retailprice < hi GROUP BY lo
UNION ALL SELECT -1, CAST(count(*) AS INTEGER), round(avg(p_size), 6) FROM part WHERE p_retailprice < 0 OR p_retailprice >= 9000 OR p_retailprice IS NULL HAVING count(*) > 0""")  # fmt: skip
pipeline("bucket_auto", "orders", [{"$bucketAuto": {"groupBy": "$o_totalprice", "buckets": 7, "output": {"count": {"$sum": 1}, "keys": {"$sum": "$o_custkey"}}}}, {"$project": {"_id": 0, "lo": "$_id.min", "hi": "$_id.max", "count": 1}}],
    "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS count FROM (SELECT o_totalprice, ntile(7) OVER (ORDER BY o_totalprice) AS t FROM orders) GROUP BY t")

# ---- arrays and several collections --------------------------------------------------------------------------------

pipeline("unwind", "accounts", [{"$unwind": "$tags"}, {"$project": {"account_id": 1, "tags": 1}}], "SELECT account_id, unnest(tags) AS tags FROM accounts")
pipeline(
    "unwind_index_preserve", "accounts",
    [{"$unwind": {"path": "$tags", "includeArrayIndex": "at", "preserveNullAndEmptyArrays": True}}, {"$project": {"account_id": 1, "tags": 1, "at": 1}}],
    "SELECT account_id, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE [NULL] END) AS tags, unnest(CASE WHEN len(tags) > 0 THEN range(len(tags)) ELSE [NULL] END) AS at FROM accounts",
)
pipeline("unwind_documents", "compat_reports", [{"$unwind": "$results"}, {"$group": {"_id": "$results.category", "n": {"$sum": 1}}}, {"$project": {"_id": 0, "category": "$_id", "n": 1}}], "SELECT r.category AS category, count(*) AS n FROM (SELECT unnest(results) AS r FROM compat_reports) GROUP BY 1")
pipeline("lookup_size", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$o"}}}], "SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
pipeline("lookup_unwind", "nation", [{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}, {"$project": {"n_name": 1, "region": "$r.r_name"}}], "SELECT n_name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
pipeline("lookup_unwind_left", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "key": "$o.o_orderkey"}}], "SELECT c_custkey, o_orderkey AS key FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
pipeline("lookup_anti", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$size": 0}}}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
pipeline("lookup_semi", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$ne": []}}}, {"$unset": "o"}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
pipeline("lookup_pipeline", "region", [{"$lookup": {"from": "nation", "pipeline": [{"$match": {"n_regionkey": {"$lt": 2}}}], "as": "n"}}, {"$project": {"r_name": 1, "n": {"$size": "$n"}}}], "SELECT r_name, CAST((SELECT count(*) FROM nation WHERE n_regionkey < 2) AS INTEGER) AS n FROM region")
pipeline(
    "lookup_let", "nation",
    [{"$lookup": {"from": "supplier", "let": {"k": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$s_nationkey", "$$k"]}, {"$gt": ["$s_acctbal", 1000]}]}}}], "as": "s"}}, {"$project": {"n_name": 1, "n": {"$size": "$s"}}}],
    "SELECT n_name, CAST(count(s_suppkey) AS INTEGER) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 1000 GROUP BY n_name",
)
pipeline(
    "lookup_array", "accounts",
    [{"$addFields": {"keys": {"$cond": [{"$gt": ["$score", 50]}, {"$literal": [1, 2]}, {"$literal": [2, 30]}]}}}, {"$lookup": {"from": "nation", "localField": "keys", "foreignField": "n_nationkey", "as": "n"}}, {"$project": {"account_id": 1, "n": {"$size": "$n"}}}],
    "SELECT account_id, CASE WHEN score > 50 THEN 2 ELSE 1 END AS n FROM accounts",
)
pipeline("union_with", "supplier", [{"$project": {"_id": 0, "name": "$s_name", "key": "$s_nationkey"}}, {"$unionWith": {"coll": "customer", "pipeline": [{"$match": {"c_acctbal": {"$lt": 0}}}, {"$project": {"name": "$c_name", "key": "$c_nationkey"}}]}}], "SELECT s_name AS name, s_nationkey AS key FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer WHERE c_acctbal < 0")
pipeline("union_distinct", "supplier", [{"$project": {"_id": 0, "key": "$s_nationkey"}}, {"$unionWith": {"coll": "customer", "pipeline": [{"$project": {"key": "$c_nationkey"}}]}}, {"$group": {"_id": "$key"}}, {"$project": {"_id": 0, "key": "$_id"}}], "SELECT s_nationkey AS key FROM supplier UNION SELECT c_nationkey FROM customer")
pipeline(
    "facet", "orders",
    [{"$facet": {"byStatus": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}, {"$sort": {"n": -1, "_id": 1}}], "top": [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 3}], "all": [{"$count": "n"}]}},
     {"$project": {"groups": {"$size": "$byStatus"}, "most": {"$arrayElemAt": ["$byStatus.n", 0]}, "best": {"$arrayElemAt": ["$top.o_orderkey", 0]}, "all": {"$arrayElemAt": ["$all.n", 0]}}}],
    """SELECT CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS groups, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) AS most,
arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, CAST(count(*) AS INTEGER) AS "all" FROM orders""",
)

# ---- scalar expressions --------------------------------------------------------------------------------------------

_MATH = {
    "math_arithmetic": {
        "a": ({"$add": ["$l_quantity", "$l_linenumber", 3]}, "l_quantity + l_linenumber + 3"),
        "b": ({"$subtract": ["$l_orderkey", "$l_partkey"]}, "l_orderkey - l_partkey"),
        "c": ({"$multiply": ["$l_quantity", "$l_extendedprice"]}, "l_quantity * l_extendedprice"),
        "d": ({"$divide": ["$l_extendedprice", "$l_quantity"]}, "l_extendedprice / l_quantity"),
        "e": ({"$mod": ["$l_extendedprice", 7]}, "l_extendedprice % 7::DOUBLE"),
        "f": ({"$add": ["$l_returnflag", 1]}, "CAST(NULL AS DOUBLE)"),
    },
    "math_rounding": {
        "a": ({"$abs": {"$subtract": ["$l_linenumber", 4]}}, "abs(l_linenumber - 4)::DOUBLE"),
        "b": ({"$ceil": "$l_extendedprice"}, "ceil(l_extendedprice)"),
        "c": ({"$floor": ["$l_extendedprice"]}, "floor(l_extendedprice)"),
        "d": ({"$trunc": [{"$subtract": [50, "$l_extendedprice"]}, 1]}, "trunc((50 - l_extendedprice) * 10::DOUBLE) / 10"),
        "e": ({"$round": ["$l_extendedprice", 1]}, "floor(l_extendedprice * 10::DOUBLE + 0.5::DOUBLE) / 10"),
        "f": ({"$round": "$l_discount"}, "floor(l_discount + 0.5::DOUBLE)"),
    },
    "math_powers": {
        "a": (R({"$sqrt": "$l_extendedprice"}, 6), "round(sqrt(l_extendedprice), 6)"),
        "b": (R({"$pow": ["$l_quantity", 2]}, 6), "round(pow(l_quantity, 2), 6)"),
        "c": (R({"$exp": "$l_discount"}, 6), "round(exp(l_discount), 6)"),
        "d": (R({"$ln": "$l_extendedprice"}, 6), "round(ln(l_extendedprice), 6)"),
        "e": (R({"$log10": "$l_extendedprice"}, 6), "round(log10(l_extendedprice), 6)"),
        "f": (R({"$log": ["$l_extendedprice", 2]}, 6), "round(ln(l_extendedprice) / ln(2), 6)"),
    },
}
for _name, _exprs in _MATH.items():
    project(_name, "lineitem", "l_orderkey", _exprs)
    project(f"{_name}_all", "lineitem", "l_orderkey", {"l_linenumber": (1, "l_linenumber"), **_exprs})
project("compare_ops", "accounts", "account_id", {
    "a": ({"$cmp": ["$score", 50]}, "CASE WHEN score IS NULL OR score < 50 THEN -1 WHEN score = 50 THEN 0 ELSE 1 END"),
    "b": ({"$eq": ["$dept", "research"]}, "dept IS NOT DISTINCT FROM 'research'"),
    "c": ({"$ne": ["$dept", "research"]}, "dept IS DISTINCT FROM 'research'"),
    "d": ({"$gt": ["$score", 50]}, "coalesce(score > 50, false)"),
    "e": ({"$gte": ["$score", 50]}, "coalesce(score >= 50, false)"),
    "f": ({"$lt": ["$score", 50]}, "coalesce(score < 50, true)"),
    "g": ({"$lte": ["$score", 50]}, "coalesce(score <= 50, true)"),
})
project("bool_ops", "accounts", "account_id", {
    "a": ({"$and": ["$score", "$dept"]}, "coalesce(score <> 0, false) AND coalesce(dept <> '', false)"),
    "b": ({"$or": [{"$gt": ["$score", 90]}, {"$eq": ["$dept", None]}]}, "coalesce(score > 90, false) OR dept IS NULL"),
    "c": ({"$not": ["$score"]}, "NOT coalesce(score <> 0, false)"),
})
project("cond_ops", "accounts", "account_id", {
    "a": ({"$cond": [{"$gt": ["$score", 50]}, "high", "low"]}, "CASE WHEN score > 50 THEN 'high' ELSE 'low' END"),
    "b": ({"$cond": {"if": "$dept", "then": "$score", "else": -1}}, "CASE WHEN dept <> '' THEN score ELSE -1 END"),
    "c": ({"$ifNull": ["$dept", "$status", "none"]}, "coalesce(dept, status, 'none')"),
    "d": ({"$switch": {"branches": [{"case": {"$gte": ["$score", 80]}, "then": "A"}, {"case": {"$gte": ["$score", 50]}, "then": "B"}], "default": "C"}}, "CASE WHEN score >= 80 THEN 'A' WHEN score >= 50 THEN 'B' ELSE 'C' END"),
})
project("type_ops", "orders", "o_orderkey", {
    "a": ({"$type": "$o_orderkey"}, "'long'"),
    "b": ({"$toString": "$o_custkey"}, "CAST(o_custkey AS VARCHAR)"),
    "c": ({"$toInt": "$o_totalprice"}, "CAST(trunc(o_totalprice) AS INTEGER)"),
    "d": ({"$toLong": {"$concat": ["1", {"$toString": "$o_custkey"}]}}, "CAST('1' || o_custkey AS BIGINT)"),
    "e": ({"$toDouble": "$o_custkey"}, "CAST(o_custkey AS DOUBLE)"),
    "f": ({"$toBool": {"$mod": ["$o_orderkey", 2]}}, "o_orderkey % 2 <> 0"),
    "g": ({"$toLong": {"$toDate": {"$multiply": ["$o_orderkey", 1000]}}}, "o_orderkey * 1000"),
    "h": ({"$convert": {"input": "$o_orderpriority", "to": "int", "onError": -1, "onNull": 0}}, "-1"),
    "i": ({"$toString": {"$toDate": "2024-03-15T10:30:45Z"}}, "'2024-03-15T10:30:45Z'"),
    "j": ({"$toObjectId": "0123456789ABCDEF01234567"}, "'0123456789abcdef01234567'"),
    "k": ({"$toDouble": {"$toDecimal": "$o_custkey"}}, "CAST(o_custkey AS DOUBLE)"),
})
project("str_basic", "part", "p_partkey", {
    "a": ({"$concat": ["$p_brand", "/", "$p_type"]}, "p_brand || '/' || p_type"),
    "b": ({"$toUpper": "$p_name"}, "upper(p_name)"),
    "c": ({"$toLower": "$p_brand"}, "lower(p_brand)"),
    "d": ({"$strLenBytes": "$p_name"}, "CAST(strlen(p_name) AS INTEGER)"),
    "e": ({"$strLenCP": "$p_name"}, "CAST(length(p_name) AS INTEGER)"),
    "f": ({"$strcasecmp": ["$p_type", "medium"]}, "CASE WHEN lower(p_type) < 'medium' THEN -1 WHEN lower(p_type) > 'medium' THEN 1 ELSE 0 END"),
    "g": ({"$trim": {"input": {"$concat": ["  ", "$p_name", " \t"]}}}, "p_name"),
    "h": ({"$ltrim": {"input": "$p_brand", "chars": "Bra"}}, "ltrim(p_brand, 'Bra')"),
    "i": ({"$rtrim": {"input": "$p_name", "chars": "tedg"}}, "rtrim(p_name, 'tedg')"),
})
project("str_parts", "part", "p_partkey", {
    "a": ({"$substrCP": ["$p_name", 2, 4]}, "substr(p_name, 3, 4)"),
    "b": ({"$substrBytes": ["$p_name", 1, 3]}, "substr(p_name, 2, 3)"),
    "c": ({"$substr": ["$p_name", 3, -1]}, "substr(p_name, 4)"),
    "d": ({"$indexOfCP": ["$p_name", "d"]}, "CAST(instr(p_name, 'd') - 1 AS INTEGER)"),
    "e": ({"$indexOfBytes": ["$p_name", "i", 3]}, "CAST(CASE WHEN instr(substr(p_name, 4), 'i') > 0 THEN instr(substr(p_name, 4), 'i') + 2 ELSE -1 END AS INTEGER)"),
    "f": ({"$arrayElemAt": [{"$split": ["$p_name", " "]}, 0]}, "split_part(p_name, ' ', 1)"),
    "g": ({"$size": {"$split": ["$p_name", "e"]}}, "CAST(len(string_split(p_name, 'e')) AS INTEGER)"),
    "h": ({"$replaceOne": {"input": "$p_name", "find": "e", "replacement": "<E>"}}, "regexp_replace(p_name, 'e', '<E>')"),
    "i": ({"$replaceAll": {"input": "$p_name", "find": "e", "replacement": "_"}}, "replace(p_name, 'e', '_')"),
})
project("str_regex", "part", "p_partkey", {
    "a": ({"$regexMatch": {"input": "$p_name", "regex": "^(red|blue)", "options": "i"}}, "regexp_matches(p_name, '^(red|blue)')"),
    "b": ({"$let": {"vars": {"m": {"$regexFind": {"input": "$p_brand", "regex": "#([0-9])([0-9]?)"}}}, "in": "$$m.match"}}, "nullif(regexp_extract(p_brand, '#([0-9])([0-9]?)'), '')"),
    "c": ({"$let": {"vars": {"m": {"$regexFind": {"input": "$p_brand", "regex": "#([0-9])([0-9]?)"}}}, "in": {"$arrayElemAt": ["$$m.captures", 0]}}}, "nullif(regexp_extract(p_brand, '#([0-9])([0-9]?)', 1), '')"),
    "d": ({"$size": {"$regexFindAll": {"input": "$p_name", "regex": "[aeiou]"}}}, "CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER)"),
})
project("date_parts", "events", "event_id", {
    "a": ({"$year": "$ts"}, "CAST(year(ts) AS INTEGER)"), "b": ({"$month": "$ts"}, "CAST(month(ts) AS INTEGER)"),
    "c": ({"$dayOfMonth": "$ts"}, "CAST(day(ts) AS INTEGER)"), "d": ({"$hour": "$ts"}, "CAST(hour(ts) AS INTEGER)"),
    "e": ({"$minute": "$ts"}, "CAST(minute(ts) AS INTEGER)"), "f": ({"$second": "$ts"}, "CAST(second(ts) AS INTEGER)"),
    "g": ({"$millisecond": {"date": "$ts"}}, "CAST(epoch_us(ts) // 1000 % 1000 AS INTEGER)"), "h": ({"$dayOfYear": "$ts"}, "CAST(dayofyear(ts) AS INTEGER)"),
    "i": ({"$dayOfWeek": "$ts"}, "CAST(dayofweek(ts) + 1 AS INTEGER)"), "j": ({"$week": "$ts"}, "CAST(weekofyear(ts) AS INTEGER)"),
    "k": ({"$isoWeek": "$ts"}, "CAST(weekofyear(ts) AS INTEGER)"), "l": ({"$isoDayOfWeek": "$ts"}, "CAST(isodow(ts) AS INTEGER)"),
    "m": ({"$isoWeekYear": "$ts"}, "CAST(isoyear(ts) AS INTEGER)"),
})
project("date_math", "orders", "o_orderkey", {
    "a": ({"$toLong": {"$add": ["$o_orderdate", 86400000]}}, "epoch_ms(o_orderdate) + 86400000"),
    "b": ({"$subtract": ["$o_orderdate", {"$toDate": "1995-01-01"}]}, "epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01')"),
    "c": ({"$toLong": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "month", "amount": 1}}}, "epoch_ms(o_orderdate + INTERVAL 1 MONTH)"),
    "d": ({"$toLong": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "hour", "amount": -5}}}, "epoch_ms(o_orderdate - INTERVAL 5 HOUR)"),
    "e": ({"$dateDiff": {"startDate": {"$toDate": "1995-01-15"}, "endDate": "$o_orderdate", "unit": "month"}}, "date_diff('month', TIMESTAMP '1995-01-15', o_orderdate)"),
    "f": ({"$dateDiff": {"startDate": "$o_orderdate", "endDate": {"$toDate": "1998-01-01T12:00:00Z"}, "unit": "week"}}, "CAST(trunc((epoch_ms(TIMESTAMP '1998-01-01 12:00:00') - epoch_ms(o_orderdate)) / 604800000.0::DOUBLE) AS BIGINT)"),
    "g": ({"$dateDiff": {"startDate": {"$toDate": "1995-01-15"}, "endDate": "$o_orderdate", "unit": "quarter"}}, "date_diff('quarter', TIMESTAMP '1995-01-15', o_orderdate)"),
    "h": ({"$toLong": {"$dateTrunc": {"date": "$o_orderdate", "unit": "month"}}}, "epoch_ms(date_trunc('month', o_orderdate)::TIMESTAMP)"),
    "i": ({"$toLong": {"$dateTrunc": {"date": "$o_orderdate", "unit": "week"}}}, "epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) - dayofweek(o_orderdate) * 86400000"),
})
project("date_text", "events", "event_id", {
    "a": ({"$dateToString": {"date": "$ts", "format": "%Y/%m/%d %H:%M:%S day %j"}}, "strftime(ts, '%Y/%m/%d %H:%M:%S day %j')"),
    "b": ({"$dateToString": {"date": "$ts"}}, "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"),
    "c": ({"$dateToString": {"date": "$ts", "format": "%u-%V"}}, "CAST(dayofweek(ts) AS VARCHAR) || '-' || strftime(ts, '%V')"),
    "d": ({"$toLong": {"$dateFromString": {"dateString": {"$dateToString": {"date": "$ts", "format": "%Y-%m-%d"}}}}}, "epoch_ms(date_trunc('day', ts)::TIMESTAMP)"),
    "e": ({"$dateFromString": {"dateString": "x", "onError": None}}, "NULL"),
})
_A = {"$slice": ["$embedding", 6]}
project("arr_basic", "embeddings", "vec_id", {
    "a": ({"$size": "$embedding"}, "CAST(len(embedding) AS INTEGER)"),
    "b": ({"$arrayElemAt": ["$embedding", -1]}, "embedding[-1]"),
    "c": ({"$first": "$embedding"}, "embedding[1]"), "d": ({"$last": "$embedding"}, "embedding[-1]"),
    "e": ({"$arrayElemAt": [{"$reverseArray": "$embedding"}, 1]}, "embedding[-2]"),
    "f": ({"$arrayElemAt": [{"$slice": ["$embedding", -3]}, 0]}, "embedding[-3]"),
    "g": ({"$arrayElemAt": [{"$slice": ["$embedding", 2, 2]}, 1]}, "embedding[4]"),
    "h": ({"$isArray": "$embedding"}, "true"), "i": ({"$isArray": ["$label"]}, "false"),
    "j": ({"$in": ["$label", [1, 3, 5]]}, "label IN (1, 3, 5)"),
    "k": ({"$indexOfArray": [[0, 1, 2, 3], "$label"]}, "CASE WHEN label BETWEEN 0 AND 3 THEN label ELSE -1 END"),
    "l": ({"$size": {"$concatArrays": ["$embedding", [1.0], [2.0]]}}, "CAST(len(embedding) + 2 AS INTEGER)"),
    "m": ({"$arrayElemAt": ["$embedding", 100000]}, "CAST(NULL AS FLOAT)"),
})
project("arr_lambda", "embeddings", "vec_id", {
    "a": ({"$size": {"$filter": {"input": "$embedding", "as": "x", "cond": {"$gt": ["$$x", 0.1]}}}}, "CAST(len(list_filter(embedding, lambda x: x::DOUBLE > 0.1::DOUBLE)) AS INTEGER)"),
    "b": (R({"$reduce": {"input": {"$map": {"input": _A, "as": "x", "in": {"$multiply": ["$$x", "$$x"]}}}, "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 6), "round(list_sum(list_transform(embedding[1:6], lambda x: x::DOUBLE * x::DOUBLE)), 6)"),
    "c": ({"$reduce": {"input": {"$range": [0, "$label"]}, "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, "CAST(label * (label - 1) / 2 AS INTEGER)"),
    "d": ({"$size": {"$range": [10, 0, -3]}}, "4"), "e": ({"$size": {"$range": [3, 3]}}, "0"),
    "f": ({"$size": {"$zip": {"inputs": [[1, 2, 3], {"$range": [0, "$label"]}]}}}, "CAST(least(3, label) AS INTEGER)"),
    "g": ({"$size": {"$zip": {"inputs": [[1, 2, 3], {"$range": [0, "$label"]}], "useLongestLength": True, "defaults": [0, 0]}}}, "CAST(greatest(3, label) AS INTEGER)"),
    "h": ({"$let": {"vars": {"p": "$label", "q": 3}, "in": {"$multiply": ["$$p", "$$q"]}}}, "label * 3"),
})
_SETS = {
    "a": ({"$setEquals": ["$tags", ["night", "lab"]]}, "coalesce(list_sort(list_distinct(tags)) = ['lab', 'night'], false)"),
    "b": ({"$size": {"$setIntersection": ["$tags", ["lab", "night"]]}}, "CAST(len(list_intersect(tags, ['lab', 'night'])) AS INTEGER)"),
    "c": ({"$size": {"$setUnion": ["$tags", ["lab", "zzz"]]}}, "CAST(len(list_distinct(list_concat(tags, ['lab', 'zzz']))) AS INTEGER)"),
    "d": ({"$size": {"$setDifference": ["$tags", ["lab"]]}}, "CAST(len(list_distinct(list_filter(tags, lambda x: x <> 'lab'))) AS INTEGER)"),
    "e": ({"$setIsSubset": [["lab"], "$tags"]}, "coalesce(list_contains(tags, 'lab'), false)"),
    "f": ({"$anyElementTrue": [{"$map": {"input": "$tags", "as": "t", "in": {"$eq": ["$$t", "lab"]}}}]}, "coalesce(list_contains(tags, 'lab'), false)"),
    "g": ({"$allElementsTrue": [{"$map": {"input": "$tags", "as": "t", "in": {"$ne": ["$$t", "lab"]}}}]}, "CASE WHEN tags IS NULL THEN true ELSE NOT list_contains(tags, 'lab') END"),
}
# without tags the union is of the others, intersection and difference have no size
_NONE = {"b": "NULL", "c": "2", "d": "NULL"}
for _name in ("set_ops", "set_ops_all"):
    project(_name, "accounts", "account_id", {k: (e, f"CASE WHEN tags IS NULL THEN {_NONE[k]} ELSE {sql} END" if k in _NONE else sql) for k, (e, sql) in _SETS.items()})
project("obj_ops", "nation", "n_nationkey", {
    "a": ({"$size": {"$objectToArray": {"x": "$n_name", "y": "b"}}}, "2"),
    "b": ({"$let": {"vars": {"m": {"$arrayToObject": [[{"k": "x", "v": "$n_name"}, {"k": "y", "v": "z"}]]}}, "in": "$$m.x"}}, "n_name"),
    "c": ({"$let": {"vars": {"m": {"$mergeObjects": [{"x": 1, "y": "$n_regionkey"}, {"y": "$n_nationkey"}]}}, "in": "$$m.y"}}, "n_nationkey"),
    "d": ({"$literal": "$n_name"}, "'$n_name'"),
    "e": ("$$ROOT.n_name", "n_name"), "f": ("$$CURRENT.n_regionkey", "n_regionkey"),
})
pipeline("hashed_key", "nation", [{"$project": {"n_nationkey": 1, "h": {"$toHashedIndexKey": "$n_name"}}}])
pipeline("now_is_constant", "nation", [{"$group": {"_id": "$$NOW", "n": {"$sum": 1}}}, {"$project": {"_id": 0, "n": 1, "same": {"$eq": ["$_id", "$$NOW"]}, "op": {"$eq": [{"$now": {}}, "$$NOW"]}}}], "SELECT count(*) AS n, true AS same, true AS op FROM nation")


def _json_props(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    parsed = t["events"].df.withColumn("props", F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())])))
    t.tables["parsed"] = parsed
    return t["parsed"].aggregate([{"$group": {"_id": "$event_type", "total": {"$sum": "$props.k"}}}, {"$project": {"_id": 0, "type": "$_id", "total": 1}}])


QUERIES["json_props"] = _json_props
ORACLE["json_props"] = "SELECT event_type AS type, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total FROM events GROUP BY 1"

# ---- sinks and changes ---------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, d: str) -> Database:
    """A writable database in the shared folder with the tables of ``d`` registered."""
    db = Database(spark, scratch_folder(spark))
    db.tables = {t: read_table(spark, d, t) for t in ("nation", "customer", "supplier", "orders", "part", "accounts")}
    db.tables["accounts"] = db.tables["accounts"].distinct()  # whole rows are repeated
    return db


def _copy(db: Database, table: str, key: str) -> Any:
    db.write(f"{table}_copy", db.load(table).withColumnRenamed(key, "_id"))
    return db[f"{table}_copy"]


def changed(name: str, sql: str) -> Callable:
    def register(f: Callable[[Database], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, d: f(_scratch(spark, d))
        ORACLE[name] = sql
        return f

    return register


@changed("out_roundtrip", "SELECT c_mktsegment AS _id, count(*) AS n FROM customer GROUP BY 1")
def _out(db: Database) -> DataFrame:
    db["customer"].aggregate([{"$group": {"_id": "$c_mktsegment", "n": {"$sum": 1}}}, {"$out": "segments"}])
    return db["segments"].find()


@changed("merge_upsert", "SELECT s_nationkey AS _id, max(s_acctbal) AS top FROM (SELECT * FROM supplier UNION ALL SELECT -1, 'x', 99, 5.0) GROUP BY 1")
def _merge(db: Database) -> DataFrame:
    db["best"].insert([{"_id": 99, "top": 5.0}, {"_id": 3, "top": -1.0}])
    db["supplier"].aggregate([{"$group": {"_id": "$s_nationkey", "top": {"$max": "$s_acctbal"}}}, {"$merge": {"into": "best"}}])
    return db["best"].find().select("_id", "top")


@changed("merge_keep_existing", "SELECT s_nationkey AS _id, CASE WHEN s_nationkey = 3 THEN -1.0 ELSE max(s_acctbal) END AS top FROM supplier GROUP BY 1")
def _merge_keep(db: Database) -> DataFrame:
    db["best"].insert([{"_id": 3, "top": -1.0}])
    db["supplier"].aggregate([{"$group": {"_id": "$s_nationkey", "top": {"$max": "$s_acctbal"}}}, {"$merge": {"into": "best", "whenMatched": "keepExisting"}}])
    return db["best"].find().select("_id", "top")


@changed("update_operators", "SELECT n_nationkey AS _id, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END AS n_regionkey, CASE WHEN n_regionkey = 1 THEN 2 END AS extra FROM nation")
def _update(db: Database) -> DataFrame:
    c = _copy(db, "nation", "n_nationkey")
    c.update({"n_regionkey": 1}, {"$inc": {"n_regionkey": 10}, "$set": {"n_name": "x"}, "$max": {"extra": 2}}, multi=True)
    return c.find()


@changed("update_one_upsert", "SELECT n_nationkey AS _id, CASE WHEN n_nationkey = 5 THEN 'five' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 77, 'new', 3")
def _upsert(db: Database) -> DataFrame:
    c = _copy(db, "nation", "n_nationkey")
    c.update({"_id": 5}, {"$set": {"n_name": "five"}})
    c.update({"_id": 77}, {"$set": {"n_name": "new"}, "$setOnInsert": {"n_regionkey": 3}}, upsert=True)
    return c.find()


@changed("replace_one", "SELECT n_nationkey AS _id, CASE WHEN n_nationkey = 5 THEN 'five' ELSE n_name END AS n_name, CASE WHEN n_nationkey <> 5 THEN n_regionkey END AS n_regionkey FROM nation")
def _replace(db: Database) -> DataFrame:
    c = _copy(db, "nation", "n_nationkey")
    c.replace({"_id": 5}, {"n_name": "five"})
    return c.find()


@changed("delete_many", "SELECT n_nationkey AS _id, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2")
def _delete(db: Database) -> DataFrame:
    c = _copy(db, "nation", "n_nationkey")
    c.delete({"n_regionkey": 2})
    return c.find()


@changed("find_and_modify", "SELECT max(n_nationkey) AS _id, 'last' AS n_name FROM nation")
def _find_and_modify(db: Database) -> DataFrame:
    c = _copy(db, "nation", "n_nationkey")
    row = c.find_and_modify({}, {"$set": {"n_name": "last"}}, sort={"_id": -1}, new=True)
    return db.spark.createDataFrame([(row["_id"], row["n_name"])], "_id int, n_name string")


@changed("insert_unique", "SELECT n_nationkey AS _id, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'A', 1")
def _insert(db: Database) -> DataFrame:
    c = _copy(db, "nation", "n_nationkey")
    c.insert([{"_id": 100, "n_name": "A", "n_regionkey": 1}])
    try:
        c.insert([{"_id": 100, "n_name": "B", "n_regionkey": 1}])
    except ValueError:
        pass
    return c.find()


# the update operators over every order, and those of arrays over every account

_ORDERS = "SELECT o_orderkey AS _id, {} FROM orders"


@changed("update_numbers", _ORDERS.format("""CASE WHEN o_orderstatus = 'F' THEN o_custkey * 3 ELSE o_custkey END AS o_custkey,
CASE WHEN o_orderstatus = 'F' THEN least(o_totalprice, 100000.0) ELSE o_totalprice END AS o_totalprice,
CASE WHEN o_orderstatus = 'F' THEN CAST(6 AS BIGINT) END AS bits, CASE WHEN o_orderstatus = 'F' THEN -2 END AS extra"""))
def _update_numbers(db: Database) -> DataFrame:
    c = _copy(db, "orders", "o_orderkey")
    c.update({"o_orderstatus": "F"}, {"$mul": {"o_custkey": 3}, "$min": {"o_totalprice": 100000.0}, "$bit": {"bits": {"or": 7, "xor": 1}}, "$inc": {"extra": -2}}, multi=True)
    return c.find(projection={"o_custkey": 1, "o_totalprice": 1, "bits": 1, "extra": 1})


@changed("update_fields", _ORDERS.format("""CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
CASE WHEN o_totalprice > 200000 THEN o_orderstatus END AS state, CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice > 200000 AS dated"""))
def _update_fields(db: Database) -> DataFrame:
    c = _copy(db, "orders", "o_orderkey")
    c.update({"o_totalprice": {"$gt": 200000}}, {"$unset": {"o_orderpriority": ""}, "$rename": {"o_orderstatus": "state"}, "$currentDate": {"seen": True}}, multi=True)
    return c.aggregate([{"$project": {"o_orderpriority": 1, "state": 1, "o_orderstatus": 1, "dated": {"$gt": ["$seen", D(2020, 1, 1)]}}}])


_ACCOUNTS = """SELECT account_id AS _id, array_to_string({}, ',') AS tags FROM (SELECT DISTINCT account_id, tags FROM accounts)"""


def _tags(name: str, spec: dict, sql: str) -> None:
    """One array update over every account, rows without tags among them."""

    @changed(name, _ACCOUNTS.format(sql))
    def run(db: Database) -> DataFrame:
        c = _copy(db, "accounts", "account_id")
        c.update({}, spec, multi=True)
        return c.find().select("_id", F.array_join("tags", ",").alias("tags"))


_tags("update_push", {"$push": {"tags": {"$each": ["zz", "aa"], "$position": 1, "$slice": 3}}}, "list_concat(coalesce(tags, [])[1:1], ['zz', 'aa'], coalesce(tags, [])[2:])[1:3]")
_tags("update_push_sort", {"$push": {"tags": {"$each": ["mm"], "$sort": -1}}}, "list_reverse_sort(list_append(coalesce(tags, []), 'mm'))")
_tags("update_add_to_set", {"$addToSet": {"tags": {"$each": ["lab", "new", "lab"]}}}, """list_concat(coalesce(tags, []), CASE WHEN list_contains(tags, 'lab') THEN [] ELSE ['lab'] END, CASE WHEN list_contains(tags, 'new') THEN [] ELSE ['new'] END)""")
_tags("update_pop", {"$pop": {"tags": 1}}, "tags[:len(tags) - 1]")
_tags("update_pop_first", {"$pop": {"tags": -1}}, "tags[2:]")
_tags("update_pull", {"$pull": {"tags": {"$gte": "m"}}}, "list_filter(tags, lambda x: x < 'm')")
_tags("update_pull_all", {"$pullAll": {"tags": ["lab", "beta"]}}, "list_filter(tags, lambda x: x NOT IN ('lab', 'beta'))")


def _counts(db: Database, kinds: str, **values: Any) -> DataFrame:
    return db.spark.createDataFrame([tuple(int(v) for v in values.values())], ", ".join(f"{k} {kinds}" for k in values))


@changed("update_counts", """SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS matched, count(*) FILTER (WHERE o_orderstatus = 'O') AS modified, CAST(0 AS BIGINT) AS upserted FROM orders""")
def _update_counts(db: Database) -> DataFrame:
    c = _copy(db, "orders", "o_orderkey")
    r = c.update({"o_orderstatus": {"$ne": "P"}}, {"$set": {"o_orderstatus": "F"}}, multi=True)
    return _counts(db, "bigint", **r)


@changed("update_first_by_sort", _ORDERS.format("CASE WHEN (o_totalprice, -o_orderkey) = (SELECT max((o_totalprice, -o_orderkey)) FROM orders) THEN 'top' ELSE o_orderstatus END AS o_orderstatus"))
def _update_first(db: Database) -> DataFrame:
    c = _copy(db, "orders", "o_orderkey")
    c.update({}, {"$set": {"o_orderstatus": "top"}}, sort={"o_totalprice": -1, "_id": 1})
    return c.find(projection={"o_orderstatus": 1})


@changed("delete_one", "SELECT o_orderkey AS _id FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'O')")
def _delete_one(db: Database) -> DataFrame:
    c = _copy(db, "orders", "o_orderkey")
    c.delete({"o_orderstatus": "O"}, one=True)
    return c.find(projection={"_id": 1})


@changed("delete_many_orders", "SELECT o_orderkey AS _id, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'")
def _delete_orders(db: Database) -> DataFrame:
    c = _copy(db, "orders", "o_orderkey")
    c.delete({"o_orderstatus": "O"})
    return c.find(projection={"o_orderstatus": 1})


@changed("bulk_write", """SELECT o_orderkey AS _id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P'
UNION ALL VALUES (-1, 'new'), (-2, 'replaced')""")
def _bulk(db: Database) -> DataFrame:
    c = _copy(db, "orders", "o_orderkey")
    c.bulk_write(
        [
            {"insertOne": {"document": {"_id": -1, "o_orderstatus": "new"}}},
            {"insertOne": {"document": {"_id": -2, "o_orderstatus": "new"}}},
            {"insertOne": {"document": {"_id": -3, "o_orderstatus": "new"}}},
            {"updateMany": {"filter": {"o_orderstatus": "F"}, "update": {"$set": {"o_orderstatus": "done"}}}},
            {"replaceOne": {"filter": {"_id": -2}, "replacement": {"o_orderstatus": "replaced"}}},
            {"deleteOne": {"filter": {"_id": -3}}},
            {"deleteMany": {"filter": {"o_orderstatus": "P"}}},
        ]
    )
    return c.find(projection={"o_orderstatus": 1})


@changed("insert_ordered_and_unordered", """SELECT o_orderkey AS _id, o_orderstatus FROM orders UNION ALL VALUES (-1, 'a'), (-2, 'b'), (-4, 'd')""")
def _insert_unordered(db: Database) -> DataFrame:
    c = _copy(db, "orders", "o_orderkey")
    twice = db.load("orders").select(F.col("o_orderkey").alias("_id"), F.lit("again").alias("o_orderstatus"))
    for rows, ordered in (([{"_id": -1, "o_orderstatus": "a"}, {"_id": -1, "o_orderstatus": "x"}, {"_id": -9, "o_orderstatus": "x"}], True), ([{"_id": -2, "o_orderstatus": "b"}, {"_id": -1, "o_orderstatus": "x"}, {"_id": -4, "o_orderstatus": "d"}], False), (twice, False), ([{"_id": -5, "o_orderstatus": "e"}, {"_id": -4, "o_orderstatus": "x"}], None)):
        try:
            c.insert(rows, ordered=ordered)
        except DuplicateKey:
            pass
    return c.find(projection={"o_orderstatus": 1})


@changed("merge_repeated_keys", """SELECT c_custkey AS _id, coalesce(o.o_totalprice, -1.0) AS last_price FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def _merge_repeated(db: Database) -> DataFrame:
    db.write("latest", db.load("customer").select(F.col("c_custkey").alias("_id"), F.lit(-1.0).alias("last_price")))
    stages = [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$project": {"_id": "$o_custkey", "last_price": "$o_totalprice", "o_orderdate": 1, "o_orderkey": 1}}, {"$merge": {"into": "latest", "whenNotMatched": "discard"}}]
    db["orders"].aggregate(stages)
    return db["latest"].find(projection={"last_price": 1})


@changed("find_one", "SELECT o_orderkey AS _id, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _find_one(db: Database) -> DataFrame:
    c = _copy(db, "orders", "o_orderkey")
    row = c.find_one(sort={"o_totalprice": -1, "_id": 1}, projection={"o_totalprice": 1})
    return db.spark.createDataFrame([tuple(row)], c.find(projection={"o_totalprice": 1}).schema)


@changed("cursor_batches", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(s_suppkey) AS BIGINT) AS total, CAST(ceil(count(*) / 30.0) AS BIGINT) AS batches FROM supplier")
def _cursor(db: Database) -> DataFrame:
    number, rows = db["supplier"].cursor(30)
    n, total, batches = 0, None, 0
    while rows:
        keys = [r.s_suppkey for r in rows if r.s_suppkey is not None]
        n, batches = n + len(rows), batches + 1
        if keys:
            total = (total or 0) + sum(keys)
        number, rows = db.get_more(number) if number else (0, [])
    return db.spark.createDataFrame([(n, total, batches)], "n bigint, total bigint, batches bigint")


@changed("index_lookup", "SELECT o_orderkey AS _id, o_custkey FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)")
def _index(db: Database) -> DataFrame:
    """Equality on an indexed field of rows laid out by the index, read through a second handle."""
    c = _copy(db, "orders", "o_orderkey")
    c.create_index({"o_custkey": 1})
    c.reindex("o_custkey_1")
    other = Database(db.spark, db.root)["orders_copy"]
    top = other.find_one(sort={"o_custkey": -1}).o_custkey
    return other.find({"o_custkey": top}, {"o_custkey": 1})


@changed("unique_index", "SELECT DISTINCT account_id AS _id, username FROM accounts UNION ALL VALUES (-1, 'someone new')")
def _unique(db: Database) -> DataFrame:
    c = _copy(db, "accounts", "account_id")
    c.create_index({"username": 1}, unique=True)
    other = Database(db.spark, db.root)["accounts_copy"]  # the index holds for every handle
    taken = c.find_one(sort={"_id": 1}).username
    try:
        other.insert([{"_id": -1, "username": "someone new"}, {"_id": -2, "username": taken}], ordered=False)
    except DuplicateKey:
        pass
    return other.find(projection={"username": 1})


@changed("collections", """SELECT 'kept' AS name, CAST(0 AS BIGINT) AS indexes, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'suppliers', CAST(1 AS BIGINT), count(*) FROM supplier""")
def _collections(db: Database) -> DataFrame:
    """create, rename, drop, list, stats and validate."""
    _copy(db, "supplier", "s_suppkey").create_index({"s_name": 1})
    db.rename("supplier_copy", "suppliers")
    db.create("kept", "_id int, v string")
    db.create("gone", "_id int")
    db.drop("gone")
    mine = [n for n in db.list_collections() if n not in db.tables]
    checked = [db.validate(n) for n in mine]
    return db.spark.createDataFrame([(n, db.stats(n)["nindexes"] - 1, v["nrecords"]) for n, v in zip(mine, checked) if v["valid"]], "name string, indexes bigint, n bigint")


@changed("db_aggregate", "SELECT CAST(0 AS INTEGER) AS n")
def _db_aggregate(db: Database) -> DataFrame:
    return db.aggregate([{"$count": "n"}])


# ---- more lookups, projections and filters -------------------------------------------------------------------------

pipeline("lookup_top_per_key", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "pipeline": [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 2}, {"$project": {"_id": 0, "o_orderkey": 1}}], "as": "best"}}, {"$unwind": "$best"}, {"$project": {"c_custkey": 1, "o_orderkey": "$best.o_orderkey"}}],
         "SELECT c_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) o JOIN customer ON c_custkey = o_custkey WHERE r <= 2")
pipeline("lookup_group_per_key", "customer", [{"$lookup": {"from": "orders", "let": {"k": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$k"]}}}, {"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 1}], "as": "s"}}, {"$project": {"c_custkey": 1, "most": {"$arrayElemAt": ["$s._id", 0]}, "n": {"$arrayElemAt": ["$s.n", 0]}}}],
         "SELECT c_custkey, s.o_orderstatus AS most, s.n FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) AS r FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)) s ON s.o_custkey = c_custkey AND s.r = 1")


def _with_tags(spark: SparkSession, d: str) -> Tables:
    t = Tables(spark, d)
    t.tables["people"] = cut_lineage(read_table(spark, d, "accounts").distinct())
    return t


_PEOPLE = "p AS (SELECT DISTINCT account_id, tags FROM accounts), l AS (SELECT DISTINCT account_id, unnest(tags) AS tag FROM p)"


def _lookup_arrays(spark: SparkSession, d: str) -> DataFrame:
    """How many accounts share a tag with each; each counts once however many tags they share."""
    t = _with_tags(spark, d)
    t.tables["others"] = t.tables["people"].where("account_id <= 40").select(F.col("account_id").alias("other"), "tags")
    look = {"$lookup": {"from": "others", "localField": "tags", "foreignField": "tags", "as": "same"}}
    return t["people"].aggregate([look, {"$project": {"account_id": 1, "n": {"$size": "$same"}}}])


QUERIES["lookup_array_both"] = _lookup_arrays
ORACLE["lookup_array_both"] = f"WITH {_PEOPLE} SELECT p.account_id, CAST((SELECT count(DISTINCT b.account_id) FROM l a JOIN l b ON a.tag = b.tag AND b.account_id <= 40 WHERE a.account_id = p.account_id) AS INTEGER) AS n FROM p"


def _lookup_array_keys(how: list[dict]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        t = _with_tags(spark, d)
        t.tables["wanted"] = spark.createDataFrame([("lab",), ("beta",)], "tag string")
        return t["people"].aggregate([{"$lookup": {"from": "wanted", "localField": "tags", "foreignField": "tag", "as": "w"}}, *how, {"$project": {"account_id": 1}}])

    return query


QUERIES["lookup_array_semi"] = _lookup_array_keys([{"$match": {"w": {"$ne": []}}}, {"$unset": "w"}])
ORACLE["lookup_array_semi"] = f"WITH {_PEOPLE} SELECT DISTINCT account_id FROM l WHERE tag IN ('lab', 'beta')"
QUERIES["lookup_array_anti"] = _lookup_array_keys([{"$match": {"w": []}}])
ORACLE["lookup_array_anti"] = f"WITH {_PEOPLE} SELECT account_id FROM p WHERE account_id NOT IN (SELECT account_id FROM l WHERE tag IN ('lab', 'beta'))"
project("cond_ternary", "orders", "o_orderkey", {
    "a": ({"$cond_ternary": [{"$gt": ["$o_totalprice", 150000]}, "high", "low"]}, "CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END"),
})
pipeline("remove_variable", "orders", [{"$project": {"o_orderkey": 1, "o_custkey": "$$REMOVE", "o_orderstatus": 1}}, {"$set": {"o_orderstatus": "$$REMOVE", "kept": "$o_orderkey"}}], "SELECT o_orderkey, o_orderkey AS kept FROM orders")
pipeline("redact_keep", "accounts", [{"$redact": {"$cond": [{"$eq": ["$dept", "research"]}, "$$KEEP", {"$cond": [{"$gt": ["$age", 60]}, "$$PRUNE", "$$DESCEND"]}]}}, {"$project": {"account_id": 1, "age": "$profile.age"}}],
         "SELECT account_id, CASE WHEN dept = 'research' OR NOT coalesce(profile.age > 60, false) THEN profile.age END AS age FROM accounts")
pipeline("match_bare_pattern", "part", [{"$match": {"p_name": re.compile("^r.*d", re.I)}}, {"$project": {"p_partkey": 1}}], "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^r.*d', 'i')")
find("find_nested_projection", "accounts", "SELECT account_id, profile.city AS city FROM accounts", projection={"account_id": 1, "city": "$profile.city"})


def _positional(spark: SparkSession, d: str) -> DataFrame:
    found = Tables(spark, d)["accounts"].find({"tags": {"$gte": "m"}}, {"account_id": 1, "tags.$": 1})
    return found.select("account_id", F.array_join("tags", ",").alias("tag"))


QUERIES["find_positional"] = _positional
ORACLE["find_positional"] = "SELECT account_id, list_filter(tags, lambda x: x >= 'm')[1] AS tag FROM accounts WHERE len(list_filter(tags, lambda x: x >= 'm')) > 0"
pipeline("hashed_key_groups", "part", [{"$group": {"_id": {"$toHashedIndexKey": "$p_brand"}, "brand": {"$first": "$p_brand"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "brand": 1, "n": 1}}], "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1")
pipeline("first_last_mixed", "orders", [{"$sort": {"o_orderdate": 1, "o_totalprice": -1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}, {"$project": {"_id": 0, "custkey": "$_id", "first": 1, "last": 1}}],
         "SELECT o_custkey AS custkey, arg_min(o_orderkey, (o_orderdate, -o_totalprice)) AS first, arg_max(o_orderkey, (o_orderdate, -o_totalprice)) AS last FROM orders GROUP BY 1")

# ---- documents of no fixed schema: the JSON texts of the audit log, broken ones among them ---------------------------

_J = "j AS (SELECT event_id, CASE WHEN json_valid(details) THEN CAST(details AS JSON) END AS doc FROM audit_events)"


def documents(name: str, stages: list[dict], columns: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A pipeline in document mode over the details of every audit event; texts that are no JSON are no documents."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        docs = document.documents(spark, read_table(spark, d, "audit_events"), "details")
        return columns(document.aggregate(docs.where("doc IS NOT NULL"), stages))

    QUERIES[name] = query
    ORACLE[name] = f"WITH {_J} {sql}"


documents("doc_match", [{"$match": {"durMs": {"$type": "int", "$gt": 4000, "$mod": [10, 7]}, "$or": [{"mech": {"$regex": "^scram", "$options": "i"}}, {"opts.dry": True}, {"keys": {"$exists": False}}]}}, {"$count": "n"}], lambda df: df,
          "SELECT CAST(count(*) AS INTEGER) AS n FROM j WHERE json_type(doc, '$.durMs') IN ('UBIGINT', 'BIGINT') AND CAST(doc->>'durMs' AS BIGINT) > 4000 AND CAST(doc->>'durMs' AS BIGINT) % 10 = 7 AND (coalesce(regexp_matches(doc->>'mech', '^scram', 'i'), false) OR coalesce(doc->>'$.opts.dry' = 'true', false) OR NOT json_exists(doc, '$.keys'))")
documents("doc_missing_and_null", [{"$group": {"_id": "$opts.tier", "n": {"$sum": 1}}}, {"$sort": {"n": -1}}], lambda df: df.select(F.coalesce(F.to_json("_id"), F.lit("null")).alias("tier"), "n"),
          "SELECT coalesce(CAST(json_extract(doc, '$.opts.tier') AS VARCHAR), 'null') AS tier, count(*) AS n FROM j WHERE doc IS NOT NULL GROUP BY 1")
documents("doc_group", [{"$group": {"_id": "$mech", "n": {"$sum": 1}, "total": {"$sum": "$durMs"}, "top": {"$max": "$keys"}}}], lambda df: df.select(F.try_variant_get("_id", "$", "string").alias("mech"), "n", "total", F.try_variant_get("top", "$", "double").alias("top")),
          "SELECT doc->>'mech' AS mech, count(*) AS n, coalesce(sum(CAST(doc->>'durMs' AS DOUBLE)), 0) AS total, CAST(max(CAST(doc->>'keys' AS BIGINT)) AS DOUBLE) AS top FROM j WHERE doc IS NOT NULL GROUP BY 1")
documents("doc_project_sort", [{"$match": {"keys": {"$gte": 35}}}, {"$project": {"durMs": 1, "who": "$mech", "dry": "$opts.dry"}}, {"$match": {"$expr": {"$gt": ["$durMs", 6900]}}}], lambda df: document.project(df, {"ms": "durMs:bigint", "who": "who:string", "dry": "dry:boolean"}),
          "SELECT CAST(doc->>'durMs' AS BIGINT) AS ms, doc->>'mech' AS who, CAST(doc->>'$.opts.dry' AS BOOLEAN) AS dry FROM j WHERE CAST(doc->>'keys' AS BIGINT) >= 35 AND CAST(doc->>'durMs' AS BIGINT) > 6900")

# ---- streams: every event read as a stream, in small batches, to the end -----------------------------------------------


def _stream(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The events as a stream of files, and a folder for its results."""
    folder = scratch_folder(spark)
    events = read_table(spark, d, "events")
    events.repartition(8, "event_id").write.parquet(f"{folder}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "3").parquet(f"{folder}/in"), folder


def _drained(df: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream to its end; each batch is appended, or in complete mode replaces the one before."""
    out = f"{folder}/out"
    write = lambda b, _: b.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _stream_rows(spark: SparkSession, d: str) -> DataFrame:
    stream, folder = _stream(spark, d)
    return _drained(stream_pipeline(stream, [{"$match": {"value": {"$gte": 20}}}, {"$project": {"event_id": 1, "twice": {"$multiply": ["$value", 2]}}}]), folder, "append")


def _stream_windows(spark: SparkSession, d: str) -> DataFrame:
    stream, folder = _stream(spark, d)
    grouped = windowed_group(stream, "ts", {"_id": "$event_type", "n": {"$sum": 1}, "top": {"$max": "$value"}}, "1 hour")
    return _drained(grouped, folder, "complete").select(F.unix_micros("start").alias("start_us"), F.col("_id").alias("type"), "n", "top")


QUERIES |= {"stream_rows": _stream_rows, "stream_windows": _stream_windows}
ORACLE |= {
    "stream_rows": "SELECT event_id, value * 2 AS twice FROM events WHERE value >= 20",
    "stream_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type AS type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2",
}

__all__ = ["ORACLE", "QUERIES", "Tables"]
