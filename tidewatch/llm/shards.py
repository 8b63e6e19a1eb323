"""Sharding by longest processing time: groups of equal texts, by falling size, to the least-loaded shard.

Groups of one size are alike to that rule, so the heap is fed by size and number of groups, the
histogram of group sizes, and gives back how many of each size go to each shard. Groups and rows
are then numbered by part: counts of each part, running totals over the parts, and a number inside it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise

#: Groups of one size from which on the heap's outcome is computed at once.
MANY = 64


def dealt(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard gets, one by one to the least load, ties to the lower shard.

    ``loads`` is brought up to date. Many groups go at once: those places are taken, out of load,
    load + size, load + 2 * size and so on of each shard, that are the ``count`` lowest.
    """
    shards = range(len(loads))
    got = [0] * len(loads)
    if count < MANY:
        heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, shard = heap[0]
            got[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
    else:
        below = lambda level: [max(0, -(-(level - loads[k]) // size)) for k in shards]
        low, high = min(loads), min(loads) + count * size + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
        got = below(low)
        rest = count - sum(got)
        for k in shards:
            if rest and loads[k] <= low and (low - loads[k]) % size == 0:
                got[k] += 1
                rest -= 1
    for k in shards:
        loads[k] += got[k] * size
    return got


def _schedule(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [0] * shards
        for batch in batches:
            ends = [list(accumulate(dealt(loads, size, count))) for size, count in
                    zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(ends, pa.list_(pa.int64()))], ["bytes", "ends"])

    return run


def in_parts(df: DataFrame, label: str) -> DataFrame:
    """``df`` written out, each row with its ``part`` and place ``pos`` for ``numbered``."""
    return materialise(df.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), label)


def numbered(df: DataFrame, within: str, name: str) -> DataFrame:
    """``df`` with a gapless number from 0 for its rows of each value of ``within``, by part and place.

    No task holds more than the rows of one part, or one count of each part.
    """
    inside = Window.partitionBy(within, "part").orderBy("pos")
    before = Window.partitionBy(within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(within, "part").agg(F.count("*").alias("rows"))
    firsts = counts.select(within, "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    return (df.withColumn(name, (F.row_number().over(inside) - 1).cast("long"))
            .join(firsts, [within, "part"]).withColumn(name, F.col(name) + F.col("first")).drop("first"))


def longest_first(docs: DataFrame, shards: int = 16, keep: list[str] | None = None) -> DataFrame:
    """Columns of ``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``; equal texts share a shard.

    The size of a row is the UTF-8 bytes of ``text`` plus 1. Groups go by falling total size to the
    shard with the least bytes, ties to the lower shard; among groups of one size any may go first.
    ``slot`` numbers the rows of a shard from 0 without gaps. A null text counts as empty; repeated rows are rows
    of one group; texts of any length are read once, and only hash, size and the columns of ``keep``
    (all but ``text`` by default) travel. Columns of ``docs`` with the names of the four are replaced.
    An empty table gives no row. Texts are told apart by 64-bit hash and size; two that
    agree in both would share a shard, which harms nothing but the order of sizes. One task keeps the
    loads and reads one row for each distinct group size: at most the square root of twice the bytes.
    """
    added = ["size", "text_crc32", "shard", "slot"]
    kept = [name for name in docs.columns if name != "text"] if keep is None else keep
    kept = [F.col(f"`{name}`") for name in kept if name.lower() not in added]
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = in_parts(docs.select(F.struct(*kept, F.lit(0).alias("__")).alias("row"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                                F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("text_hash")), "rows")
    key = ["text_hash", "size"]
    groups = in_parts(rows.groupBy(*key).agg((F.count("*") * F.col("size")).alias("bytes")), "groups")
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("groups")).repartition(1).sortWithinPartitions(F.desc("bytes"))
    plan = materialise(sizes.mapInArrow(_schedule(shards), "bytes long, ends array<long>"), "plan")
    placed = numbered(groups, "bytes", "turn").join(plan, "bytes").select(
        *key, F.size(F.filter("ends", lambda end: end <= F.col("turn"))).alias("shard"))
    home = materialise(placed, "placed")
    whole = numbered(rows.join(home, key), "shard", "slot")
    return whole.select("row.*", *added).drop("__")
