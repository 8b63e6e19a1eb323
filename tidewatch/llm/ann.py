"""Nearest neighbours by cosine: probed lists, scanned in column blocks with early abandoning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise

#: Columns of a block, and rows of a list or queries that one task holds.
BLOCK, CHUNK_ROWS, CHUNK_QUERIES = 16, 8192, 2048


@dataclass(frozen=True)
class Index:
    """A random rotation and the centres of the lists, in rotated space."""

    rotation: np.ndarray
    centres: np.ndarray

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return unit @ self.rotation

    def lists(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` lists whose centres are nearest, the nearest first."""
        near = self.rotated(vectors) @ self.centres.T
        if probes >= near.shape[1]:
            return np.argsort(-near, axis=1, kind="stable")
        some = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` without vectors that are null, empty, zero or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))
                      & F.exists("v", lambda x: x != 0))


def fit(rows: DataFrame, n: int, width: int, sample_values: int = 2_000_000, seed: int = 7) -> Index:
    """Lists for ``n`` distinct vectors of ``width`` components, from a bounded sample of them.

    The sample holds at most ``sample_values`` numbers, those vectors with the smallest
    hashes; k-means over directions runs on it.
    """
    take = max(1, sample_values // width)
    sample = rows.select("v").orderBy(F.xxhash64("v")).limit(take).toPandas()
    data = np.stack(sample["v"].to_numpy()) if len(sample) else np.zeros((0, width))
    random = np.random.default_rng(seed)
    rotation = np.linalg.qr(random.normal(size=(width, width)))[0]
    unit = data / np.linalg.norm(data, axis=1, keepdims=True) @ rotation
    lists = max(1, min(4096, round(math.sqrt(n)), len(data)))
    centres = unit[random.choice(len(unit), lists, replace=False)]
    for _ in range(10):
        own = np.concatenate([(unit[k:k + 4096] @ centres.T).argmax(axis=1) for k in range(0, len(unit), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return Index(rotation, centres)


def scan(query: np.ndarray, blocks: np.ndarray, order: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Rows of a list that may be among the ``k`` nearest of a query, all as rotated unit vectors.

    ``blocks`` has a column for each row of the list, so that one block of components of all
    rows lies together; ``order`` lists rows, the likeliest first. After each block a row is
    abandoned if the distance estimated from the components so far exceeds the k-th best by
    more than a factor of ``1 + slack / sqrt(components)``, the test of the hypothesis that
    the true distance does not.
    """
    width = len(query)
    seeds = order[:4 * k]
    far = ((blocks[:, seeds] - query[:, None]) ** 2).sum(axis=0)
    bound = np.partition(far, k - 1)[k - 1] if len(far) >= k else np.inf
    alive, part = np.arange(blocks.shape[1]), np.zeros(blocks.shape[1])
    for at in range(0, width, BLOCK):
        stop = min(at + BLOCK, width)
        part = part + ((blocks[at:stop][:, alive] - query[at:stop, None]) ** 2).sum(axis=0)
        limit = bound if stop == width else bound * (1 + slack / math.sqrt(stop)) ** 2 * stop / width
        keep = part <= limit + 1e-9
        alive, part = alive[keep], part[keep]
        if stop < width and len(alive) <= 2 * k:
            break
    return alive


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50,
            probe_share: float = 0.7, least_probes: int = 16, slack: float = 2.1) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows by cosine of each row whose id ``every`` divides.

    Every usable row is indexed and is a candidate of every query but its own; fewer than
    ``k`` candidates are all given. Ties go to the smaller id. Equal vectors are searched as
    one and stand for the ``k + 1`` smallest ids that share them, so that copies neither fill
    a list nor cost a search each. A query probes ``probe_share`` of the lists, at least
    ``least_probes``. Scores are cosines of the original vectors in double precision. Vectors
    that are null, zero or not finite, rows without an id, and vectors of another than the
    commonest length take no part; repeated rows count once. An empty table gives an empty
    result.
    """
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    kind = rows.schema["id"].dataType.simpleString()
    if not lengths:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"),
                           F.lit(0.0).alias("score"))
    width = lengths[0]["w"]
    rows = rows.where(F.size("v") == width)
    first = Window.partitionBy("v").orderBy("id")
    shared = rows.groupBy("v", "id").agg(F.lit(1).alias("one")).drop("one").withColumn(
        "place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    distinct = materialise(shared.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn(
        "key", F.expr("uuid()")), "vectors")
    n = distinct.count()
    index = fit(distinct, n, width)
    lists = len(index.centres)
    probes = min(lists, max(least_probes, math.ceil(probe_share * lists)))
    asked = rows.where(F.col("id") % every == 0).select("id", "v").distinct()
    wanted = materialise(asked.select("v").distinct().join(distinct.select("v", "key"), "v"), "queries")

    def place(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                    found = index.lists(v, count)
                    keep = np.repeat(np.arange(len(v)), found.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.ravel().astype(np.int32)), *[c.take(pa.array(keep)) for c in batch.columns]],
                        ["list", *batch.schema.names])
        return run

    placed = materialise(distinct.select("v", "key", "ids").mapInArrow(
        place(1), f"list int, v array<double>, key string, ids array<{kind}>"), "placed")
    probing = materialise(wanted.select("v", "key").mapInArrow(place(probes), "list int, v array<double>, key string"), "probing")
    size = placed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("chunks"))
    load = probing.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_QUERIES).alias("turns"))
    grid = F.broadcast(size.join(load, "list"))  # one row for each list, of which there are at most 4,096
    on = ["list", "chunk", "turn"]
    held = placed.join(grid, "list").withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    asking = probing.join(grid, "list").withColumn("turn", F.pmod(F.xxhash64("key"), "turns")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            base, ask = np.stack(right["v"].to_numpy()), np.stack(left["v"].to_numpy())
            blocks = np.ascontiguousarray(index.rotated(base).T)
            order = np.argsort(-(index.centres[left["list"].iloc[0]] @ blocks), kind="stable")
            norms = np.sqrt((base * base).sum(axis=1))
            for key, vector, turned in zip(left["key"], ask, index.rotated(ask), strict=True):
                some = scan(turned, blocks, order, k + 1, slack)
                score = (base[some] * vector).sum(axis=1) / (norms[some] * math.sqrt((vector * vector).sum()))
                if len(some) > k + 1:
                    least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    some, score = some[score >= least], score[score >= least]
                out += [(key, float(s), right["ids"].iloc[i]) for i, s in zip(some, score, strict=True)]
        return pd.DataFrame(out, columns=["key", "score", "ids"])

    found = asking.select(*on, "key", "v").groupBy(on).cogroup(held.select(*on, "key", "v", "ids").groupBy(on)).applyInPandas(
        search, f"key string, score double, ids array<{kind}>")
    # of the vectors found for a query vector only the best can matter, with those that tie
    best = found.withColumn("r", F.rank().over(Window.partitionBy("key").orderBy(F.desc("score")))).where(F.col("r") <= k + 1)
    answers = best.groupBy("key").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))
    named = answers.join(wanted, "key").select("v", "hits")
    hits = asked.join(named, "v").select(F.col("id").alias("query_id"), F.explode("hits").alias("hit")).select(
        "query_id", "hit.score", F.explode("hit.ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
