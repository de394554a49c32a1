"""Queries of the text problems 8 to 10 over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import content, mixing, packing
from tarn.llm.tokens import with_token_counts
from tarn.sources import cut_lineage, read_table

CONTAINER = 4096


def corpus(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """``cols`` of all documents; a folder of fewer files than cores is spread before work on its texts."""
    docs = read_table(spark, d, "documents").select(*cols)
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(2 * cores)


def token_table(spark: SparkSession, d: str) -> DataFrame:
    """Each document's id, source and tokens, counted once and written to the shared folder."""
    return cut_lineage(with_token_counts(corpus(spark, d, "doc_id", "source", "text"), "text"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(token_table(spark, d), "doc_id", "n_tokens", (512, 1024, 2048, CONTAINER))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    # a document is cut only if it exceeds the container, and then has exactly one second piece
    return _packed(spark, d).where(F.col("piece") == 1).select("doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(_packed(spark, d))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What every packing must satisfy, counted over the whole corpus."""
    counted = token_table(spark, d)
    packed = cut_lineage(packing.pack(counted, "doc_id", "n_tokens", (512, 1024, 2048, CONTAINER)))
    bins = packed.groupBy("bin", "bin_size", "bin_fill").agg(F.sum("piece_size").alias("filled"))
    over = bins.agg(F.sum(F.when((F.col("filled") > F.col("bin_size")) | (F.col("filled") != F.col("bin_fill")), 1).otherwise(0)).alias("overfull_bins"), F.sum("bin_size").alias("room"))
    pieces = packed.agg(
        F.countDistinct("doc_id").alias("documents"),
        F.sum("piece_size").alias("placed"),
        F.sum(F.when((F.col("item_size") <= CONTAINER) & ((F.col("piece") != 0) | (F.col("piece_size") != F.col("item_size"))), 1).otherwise(0)).alias("needless_cuts"),
    )
    tokens = counted.agg(F.sum("n_tokens").alias("tokens"))
    one = pieces.crossJoin(F.broadcast(over)).crossJoin(F.broadcast(tokens))  # one row each
    return one.select("documents", (F.col("placed") - F.col("tokens")).alias("lost_tokens"), "overfull_bins", "needless_cuts", (F.col("placed") >= 0.95 * F.col("room")).alias("at_least_95_percent_full"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sources that may be repeated rise over training, those used once fall; the shares are the same."""
    targets = read_table(spark, d, "mix_targets")
    targets = targets.withColumn("tilt", F.when(F.col("max_repeats") > 1, 0.5).otherwise(-0.5))
    return mixing.mixture(token_table(spark, d), targets, "doc_id", "source", "n_tokens", warm="tilt")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    report = _mixture(spark, d)[1]
    # the documents placed run out before the end of training
    return report.where(~F.col("reached") & (F.col("share_of_size") < F.col("target_share"))).select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p9_over_training(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares_over_training(_mixture(spark, d)[0], "source", "n_tokens")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source that has documents: what the mixture must satisfy, counted over all its rows."""
    mixed = cut_lineage(_mixture(spark, d)[0])
    caps = read_table(spark, d, "mix_targets").select("source", "max_repeats")
    per = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("epoch").alias("epochs"), F.max("epoch").alias("last"))
    per = per.join(F.broadcast(caps.limit(10_000)), "source")  # nine rows by TESTDATA.md
    odd = (F.col("uses") > F.col("max_repeats")) | (F.col("uses") != F.col("epochs")) | (F.col("last") != F.col("uses") - 1)
    outside = mixed.groupBy("source").agg(F.sum(F.when(F.col("position").between(0.0, 1.0), 0).otherwise(1)).alias("outside"))
    return per.groupBy("source").agg(F.sum(F.when(odd, 1).otherwise(0)).alias("overused"), (F.max("uses") - F.min("uses") <= 1).alias("even_epochs")).join(outside, "source")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def content_table(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d, "doc_id", "text", "lang", "source")
    net = content.fit_from_labels(read_table(spark, d, "documents"), read_table(spark, d, "content_labels"), "doc_id", "text", "lang", "offensive")
    return content.score(docs, net, "doc_id", "text", "lang", ["source", "lang"])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return content_table(spark, d).where("flagged").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return content_table(spark, d).drop("lang")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return content_table(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )


def p10_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents scored, those scored outside [0, 1], and whether every flagged score lies above every other of its language."""
    scored = content_table(spark, d)
    tag = content.language(F.col("lang"))
    cut = scored.groupBy(tag.alias("tag")).agg(F.min(F.when(F.col("flagged"), F.col("score"))).alias("low"), F.max(F.when(~F.col("flagged"), F.col("score"))).alias("high"))
    whole = cut.agg(F.coalesce(F.max(F.col("high") > F.col("low")), F.lit(False)).alias("mixed_up"))
    return scored.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(F.col("score").between(0.0, 1.0), 0).otherwise(1)).alias("outside")).crossJoin(F.broadcast(whole))  # one row each


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p8_found, p8_containers, p8_usage, p8_checks, p9_found, p9_report, p9_over_training, p9_checks, p9_mixture, p10_found, p10_scores, p10_rates, p10_checks)
}

#: token counts, layouts and networks are not expressible in SQL; it holds the invariants, and tests/llm checks the rest against brute force
ORACLE: dict[str, str] = {
    "p8_checks": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS lost_tokens, CAST(0 AS BIGINT) AS overfull_bins, CAST(0 AS BIGINT) AS needless_cuts, true AS at_least_95_percent_full FROM documents",
    "p9_checks": """SELECT DISTINCT d.source, CAST(0 AS BIGINT) AS overused, true AS even_epochs, CAST(0 AS BIGINT) AS outside
FROM documents d JOIN mix_targets t ON t.source = d.source WHERE t.target_share > 0 AND t.max_repeats > 0""",
    "p10_checks": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS outside, false AS mixed_up FROM documents",
}
