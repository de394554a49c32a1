"""Mixing sources to target weights over a training run.

Every source has a schedule of weights over training time t in [0, 1] whose
integral is its target share; the weights of all sources add up to 1 at every t.
A source's cumulative token demand is the integral of its schedule times the
size of the mixture.  Documents (repeated up to the cap) are laid out in a hashed
order, their cumulative tokens are inverted through the demand to a position in
training, and the mixture is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.skew import join_few, join_null_safe
from tarn.sources import cut_lineage


def _position(done: Column, share: Column, tilt: Column) -> Column:
    """Invert W(t) = share·(t + tilt·(t² − t)) at ``done`` = W, for −1 < tilt < 1.

    The schedule share·(1 + tilt·(2t − 1)) rises for tilt > 0.
    """
    x = F.least(F.lit(1.0), done / share)
    lin = 1 - tilt
    root = F.sqrt(lin * lin + 4 * tilt * x)
    return F.when(F.abs(tilt) < 1e-9, x).otherwise(2 * x / (lin + root))


def mixture(
    docs: DataFrame,
    targets: DataFrame,
    doc: str,
    source: str,
    tokens: str,
    total_tokens: float | None = None,
    bucket_docs: int = 200_000,
    seed: int = 17,
    warm: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    ``docs`` has ``doc``, ``source`` and its ``tokens``; ``targets`` has ``source``,
    ``target_share`` and ``max_repeats``, optionally a column ``warm`` with each source's
    tilt (null is 0).  The tilts are centred so that the weights add up to 1 at every
    time; a centred tilt outside (−1, 1) would make a weight negative and raises.
    ``total_tokens`` is the size of the mixture, by default that of all ``docs``.

    Mixture: ``doc``, ``source``, ``tokens``, ``epoch`` (from 0), ``position`` in [0, 1],
    sorted by position.  A source is used in epochs of all its documents; it stops
    before the document that would exceed its demand by more than half that
    document, or after ``max_repeats`` epochs.

    Report: one row per target source with ``target_share``, ``tokens_available`` (repeats
    included), ``tokens_used``, ``share_of_size`` (of ``total_tokens``), ``share_of_mixture``,
    ``lasts_until`` (the position at which the tokens placed run out, by the source's
    schedule; null if none was placed) and ``reached`` (they last until the end,
    but for less than a document).  All but the first two are read from the
    documents placed in the mixture.

    Running totals are per bucket of the hashed order, under a prefix over bucket
    sums, so a source with a third of all documents is never one window.  Targets are
    broadcast when counted to at most 100,000 and met by a salted join beyond.

    Defined cases: documents of unlisted or null sources are not used; a listed
    source without documents is reported with 0; null or negative token counts are 0;
    repeated targets of a source are an error; empty tables give empty results.
    """
    listed = cut_lineage(
        targets.select(
            F.col(source).alias("_s"),
            F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("_share"),
            F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0)).alias("_cap"),
            F.coalesce(F.col(warm).cast("double") if warm else F.lit(0.0), F.lit(0.0)).alias("_lean"),
        ).where(F.col("_s").isNotNull()),
        1,
    )
    if not listed.groupBy("_s").count().where("count > 1").isEmpty():
        raise ValueError("a source has more than one target")
    mean = listed.agg(F.sum(F.col("_share") * F.col("_lean")) / F.sum("_share")).first()[0] or 0.0
    plan = listed.select("_s", "_share", "_cap", (F.col("_lean") - F.lit(float(mean))).alias("_tilt"))
    if not plan.where(F.abs("_tilt") >= 1).isEmpty():
        raise ValueError("a centred tilt lies outside (-1, 1)")
    n = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long")
    all_docs = docs.select(F.col(doc).alias("_doc"), F.col(source).alias("_s"), n.alias("_n"))
    size_, count_ = all_docs.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    if total_tokens is None:
        total_tokens = float(size_)
    buckets = max(64, -(-count_ // bucket_docs))
    order = F.xxhash64(F.lit(seed), "_doc", "_n")
    placed = join_few(all_docs, plan, ["_s"], F.col("_doc")).select("_doc", "_s", "_n", "_share", "_cap", "_tilt", order.alias("_h"), F.pmod(F.shiftrightunsigned(order, 40), F.lit(buckets)).cast("int").alias("_b"))
    sums = placed.groupBy("_s", "_b").agg(F.sum("_n").alias("_sum"), F.max("_n").alias("_most"))  # at most sources x buckets rows
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        sums.select("_s", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy("_s")).alias("_all"), "_most"), 1
    )
    within = Window.partitionBy("_s", "_b").orderBy("_h", "_doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = (
        placed.withColumn("_upto", F.sum("_n").over(within))
        .join(offsets.drop("_most").hint("merge"), ["_s", "_b"])  # the running totals are already partitioned by these
        .withColumn("_start", F.col("_before") + F.col("_upto") - F.col("_n"))
    )
    demand = F.col("_share") * F.lit(float(total_tokens))
    # epochs in which this document starts early enough: start + e * all + n / 2 <= demand
    turns = F.when(F.col("_all") > 0, F.floor((demand - F.col("_start") - F.col("_n") / 2) / F.col("_all")) + 1).otherwise(0)
    turns = F.least(F.col("_cap"), F.greatest(F.lit(0), turns)).cast("int")
    used = laid.withColumn("_turns", turns).where(F.col("_turns") > 0)
    size = float(total_tokens) or 1.0
    begun = F.col("_start") + F.col("epoch") * F.col("_all")
    at = lambda upto: _position(upto / F.lit(size), F.col("_share"), F.col("_tilt"))
    spread = used.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1))).withColumn("position", at(begun + F.col("_n") / 2))
    mixed = spread.select(F.col("_doc").alias(doc), F.col("_s").alias(source), F.col("_n").alias(tokens), "epoch", "position").orderBy("position", F.col(doc), "epoch")
    taken = spread.groupBy("_s").agg(F.sum("_n").alias("_used"), F.max(begun + F.col("_n")).alias("_until"))
    have = offsets.groupBy("_s").agg(F.max("_all").alias("_have"), F.max("_most").alias("_longest"))
    base = join_null_safe(join_null_safe(plan, have, ["_s"], "left"), taken, ["_s"], "left")
    base = base.withColumns({"tokens_available": F.coalesce("_have", F.lit(0)) * F.col("_cap"), "tokens_used": F.coalesce("_used", F.lit(0))})
    report = base.select(
        F.col("_s").alias(source),
        F.col("_share").alias("target_share"),
        "tokens_available",
        "tokens_used",
        (F.col("tokens_used") / F.lit(size)).alias("share_of_size"),
        (F.col("tokens_used") / F.greatest(F.lit(1), F.sum("tokens_used").over(Window.partitionBy()))).alias("share_of_mixture"),
        F.when(F.col("_until").isNotNull(), at(F.col("_until"))).alias("lasts_until"),
        # the next document would have exceeded the demand by more than half of it
        ((F.col("_share") <= 0) | (F.col("_until").isNotNull() & (at(F.col("_until") + F.col("_longest") / 2) >= 1 - 1e-12))).alias("reached"),
    )
    return mixed, report


def shares_over_training(mixed: DataFrame, source: str, tokens: str, parts: int = 10) -> DataFrame:
    """Tokens and share of each source in each of ``parts`` equal stretches of training: ``part`` (from 0), ``source``, ``tokens``, ``share``.

    A document belongs to the stretch of its position.  Stretches and sources
    without documents give no row.
    """
    part = F.least(F.lit(parts - 1), F.floor(F.col("position") * parts)).cast("int").alias("part")
    cells = mixed.groupBy(part, F.col(source)).agg(F.sum(F.col(tokens)).alias(tokens))
    return cells.select("part", source, tokens, (F.col(tokens) / F.greatest(F.lit(1), F.sum(tokens).over(Window.partitionBy("part")))).alias("share"))
