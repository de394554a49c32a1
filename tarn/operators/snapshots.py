"""What changed between consecutive full snapshots.

Every snapshot of a stream gets its index in time.  Each key's entries are
windowed by that index: a changed hash against the previous index is a change, a
hole in the indices is a removal at the first missing snapshot and an addition
where the key comes back.  One pass serves any number of snapshots, and the
entries cross the network once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.skew import FEW
from tarn.sources import cut_lineage


def tidy(text: Column) -> Column:
    """Trimmed of white space and in lower case."""
    return F.lower(F.trim(text, F.lit(" \t\n\r\f\v")))


def instant(text: Column) -> Column:
    """A timestamp from RFC 3339 in any offset; text without offset is UTC; else null."""
    t = F.upper(F.trim(text))
    return F.coalesce(t.try_cast("timestamp"), F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))


def snapshot_changes(
    df: DataFrame,
    stream: str,
    snapshot: str,
    taken_at: Column,
    entries: str,
    name: Column,
    content: Sequence[Column],
) -> DataFrame:
    """Differences between each snapshot and the one before it in the same stream.

    ``entries`` is an array column holding the whole snapshot; ``name`` and ``content``
    are expressions over the exploded element ``_e``.  Rows: ``stream``,
    ``snapshot`` (of the later one), ``name`` and ``change`` (added, removed, changed).

    Defined cases: a snapshot delivered more than once counts once; null
    ``entries`` are no snapshot and are passed over; an empty list is a snapshot
    without entries, so everything before it was removed; snapshots without
    instant or stream cannot be placed and are left out; equal instants are ordered
    by ``snapshot``; null content is a value of its own; entries without name are
    ignored; of a name repeated in one snapshot with unlike content the least hash
    stands; a stream's first snapshot gives no row; an empty table gives none.
    """
    given = df.select(
        F.col(f"`{stream}`").alias("_s"), F.col(f"`{snapshot}`").alias("_id"), taken_at.alias("_at"), F.col(f"`{entries}`").alias("_entries")
    ).where(F.col("_entries").isNotNull() & F.col("_at").isNotNull() & F.col("_s").isNotNull())
    # the index needs the headers only: its place among a day's snapshots, after all those of earlier days,
    # so that a stream with very many snapshots is one small window per day and one over its days
    heads = given.groupBy("_s", "_id").agg(F.min("_at").alias("_at")).withColumn("_day", F.to_date("_at"))
    earlier = Window.partitionBy("_s").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = heads.groupBy("_s", "_day").agg(F.count(F.lit(1)).alias("_n"))
    days = days.select("_s", "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_s", "_day").orderBy("_at", "_id")
    heads = heads.withColumn("_rank", F.row_number().over(within)).join(days, ["_s", "_day"]).select("_s", "_id", (F.col("_before") + F.col("_rank")).alias("_i"))
    heads = cut_lineage(heads)
    few = heads.limit(FEW + 1).count() <= FEW

    placed = (F.broadcast(heads) if few else heads).withColumnsRenamed({"_s": "_hs", "_id": "_hid"})
    placed = given.select("_s", "_id", "_entries").join(placed, (F.col("_s") == F.col("_hs")) & F.col("_id").eqNullSafe(F.col("_hid")))
    hashed = F.xxhash64(*[x for c in content for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))])
    cells = placed.select("_s", "_i", F.explode("_entries").alias("_e")).select("_s", "_i", name.alias("_name"), hashed.alias("_h")).where(F.col("_name").isNotNull())
    # one exchange serves both the removal of repeats and the window
    placed = cells.repartition("_s", "_name").groupBy("_s", "_name", "_i").agg(F.min("_h").alias("_h"))
    w = Window.partitionBy("_s", "_name").orderBy("_i")
    seen = placed.select(
        "_s", "_name", "_i", "_h", F.lag("_i").over(w).alias("_pi"), F.lag("_h").over(w).alias("_ph"), F.lead("_i").over(w).alias("_ni")
    )
    here = F.when((F.col("_pi") == F.col("_i") - 1) & (F.col("_ph") != F.col("_h")), "changed").when(
        (F.col("_i") > 1) & (F.col("_pi").isNull() | (F.col("_pi") < F.col("_i") - 1)), "added"
    )
    gone = F.when(F.col("_ni").isNull() | (F.col("_ni") > F.col("_i") + 1), "removed")
    events = (
        seen.select(
            "_s",
            "_name",
            F.explode(F.array(F.struct(F.col("_i").alias("_i"), here.alias("change")), F.struct((F.col("_i") + 1).alias("_i"), gone.alias("change")))).alias("_x"),
        )
        .select("_s", "_name", "_x._i", "_x.change")
        .where(F.col("change").isNotNull())
    )
    # past the last snapshot there is no header, so its "removals" find no partner
    found = events.join(F.broadcast(heads) if few else heads, ["_s", "_i"])
    return found.select(F.col("_s").alias(stream), F.col("_id").alias(snapshot), F.col("_name").alias("name"), "change")
