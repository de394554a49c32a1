"""Filling fixed-capacity containers with items, by variable-capacity best fit.

Items are spread over shards of bounded size by hash; each shard is packed by
best-fit decreasing.  An item goes to the open bin it fills best.  When none has
room, a bin of the permitted size with the least expected cost is opened: a
bin's cost is its size plus a fixed charge, less what the items still waiting
are expected to fill.  At the end every bin shrinks to the smallest permitted
size that holds its contents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_fit(sizes: np.ndarray, capacities: Sequence[int], charge: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every item and final size of every bin.  Sizes must lie in 0..max(capacities).

    Open bins are kept by remaining room in stacks, with one bit per room that is
    present, so the best fit is the lowest set bit at or above the item's size.
    """
    caps = sorted({int(c) for c in capacities})
    top = caps[-1]
    n = len(sizes)
    bins = np.empty(n, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    # tokens in items no longer than s: what is left to fill a remainder of s with
    waiting = np.zeros(top + 1, dtype=np.int64)
    np.add.at(waiting, np.minimum(sizes, top), sizes)
    fillable = waiting.cumsum().tolist()
    total = int(sizes.sum())
    rooms: list[list[int]] = [[] for _ in range(top + 1)]
    present = 0
    opened: list[int] = []
    filled: list[int] = []
    done = 0
    for i in order.tolist():
        s = int(sizes[i])
        fit = present >> s
        if s and fit:
            room = s + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                present &= ~(1 << room)
        else:
            # least expected cost per item token: room left is lost only as far as smaller items cannot fill it
            best, b_cap = None, top
            for c in caps:
                if c < s:
                    continue
                left = c - s
                # every waiting item is at most s long; only those at most `left` long can still come in
                lost = max(0, left - (total - done - s if left >= s else fillable[left]))
                cost = (charge + lost) / max(1, c - lost)
                if best is None or cost < best:
                    best, b_cap = cost, c
            b = len(opened)
            opened.append(b_cap)
            filled.append(0)
            room = b_cap
        room -= s
        filled[b] += s
        done += s
        bins[i] = b
        if room:
            if not rooms[room]:
                present |= 1 << room
            rooms[room].append(b)
    used = np.asarray(filled, dtype=np.int64)
    final = np.asarray(caps, dtype=np.int64)[np.searchsorted(caps, used)] if len(used) else used
    return bins, np.minimum(final, np.asarray(opened, dtype=np.int64)) if len(used) else used


def pack(
    df: DataFrame,
    item: str,
    size: str,
    capacities: Sequence[int] = (512, 1024, 2048, 4096),
    shard_items: int = 50_000,
) -> DataFrame:
    """Assign items to containers: ``item``, ``piece``, ``piece_size``, ``bin`` (text), ``bin_size``, ``bin_fill``, ``item_size``.

    The largest capacity is the container; smaller ones are permitted lengths to
    which nearly empty containers shrink.  An item is whole (``piece`` 0) unless it
    exceeds the container; then it is cut into full containers and one rest, and
    only the rest shares a container.

    The number of shards follows the number of items, so a shard holds about
    ``shard_items`` small integers whatever the table's size; packing loses at most
    the last few open bins of each shard.

    Defined cases: items of null size count as 0 and are put like empty ones; an
    item of size 0 still gets a bin; repeated rows are items of their own; a null
    item is an item; an empty table gives no rows.
    """
    top = max(capacities)
    rows = df.select(F.col(f"`{item}`").alias("_item"), F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(0)).cast("long").alias("_size"))
    kind = rows.schema["_item"].dataType.simpleString()
    n = rows.count()
    shards = max(1, round(n / shard_items))
    out = f"_item {kind}, piece int, piece_size bigint, bin string, bin_size bigint, bin_fill bigint, item_size bigint"
    names = ["_item", "piece", "piece_size", "bin", "bin_size", "bin_fill", "item_size"]

    def shard_out(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        whole = table.column("_size").to_numpy()
        pieces = np.maximum(1, -(-whole // top))
        owner = np.repeat(np.arange(len(whole)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sizes = np.minimum(top, whole[owner] - piece * top)
        bins, final = best_fit(sizes, capacities)
        fill = np.zeros(len(final), dtype=np.int64)
        np.add.at(fill, bins, sizes)
        label = pa.array([f"{shard}-{b}" for b in range(len(final))])
        yield from pa.table(
            [table.column("_item").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(sizes), label.take(pa.array(bins)), pa.array(final[bins]), pa.array(fill[bins]), pa.array(whole[owner])],
            names=names,
        ).combine_chunks().to_batches(max_chunksize=10_000)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: int | None = None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at is not None and shard[a] != at and held:
                    yield from shard_out(at, held)
                    held = []
                at = int(shard[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from shard_out(at, held)

    shard = F.pmod(F.xxhash64("_item", "_size"), F.lit(shards)).alias("_shard")
    packed = (
        rows.select(shard, "_item", "_size")
        .repartition(shards, "_shard")
        .sortWithinPartitions("_shard", F.desc("_size"), "_item")
        .mapInArrow(stream, out)
    )
    return packed.withColumnRenamed("_item", item)


def usage(packed: DataFrame) -> DataFrame:
    """Per container size: ``bin_size``, ``bins``, ``room``, ``filled``, ``unused_share``.

    Every bin counts once, whatever the number of its pieces; no bins give no rows.
    """
    bins = packed.groupBy("bin", "bin_size").agg(F.sum("piece_size").alias("filled"))
    return bins.groupBy("bin_size").agg(F.count(F.lit(1)).alias("bins"), F.sum("bin_size").alias("room"), F.sum("filled").alias("filled")).withColumn(
        "unused_share", F.when(F.col("room") > 0, 1 - F.col("filled") / F.col("room"))
    )
