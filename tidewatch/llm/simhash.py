"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints are 64 bits wide. Bits that go together are put into the same partition, each
query gets a threshold for each partition by dynamic programming over estimated candidate
counts, the partitions are probed by equi joins, and candidates are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bytes_of, materialise, word_runs
from tidewatch.llm.components import components

BITS = 64
#: A bucket with more fingerprints than this is compared in numpy blocks, not row by row.
CROWD = 64
#: Fingerprints in a block of a crowded bucket.
BLOCK = 4096
#: What making, dealing out and sorting a probe costs, in comparisons of a candidate that it meets.
PROBE = 8
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The SimHash of a text's word shingles, as an unsigned 64-bit number.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space. A text of
    fewer words than ``width`` is one shingle; one without words, or null, gives zero.
    """
    set_bits, total, before = np.zeros(BITS, np.int64), 0, []
    for run in word_runs(text or b""):
        before += run
        if len(before) >= width:
            set_bits += _set_bits(before, width)
            total += len(before) - width + 1
            before = before[len(before) - width + 1:]
    if not total:
        if not before:
            return 0
        set_bits, total = _set_bits(before, len(before)), 1
    return int.from_bytes(np.packbits(2 * set_bits > total).tobytes(), "big")


def _set_bits(words: list[bytes], width: int) -> np.ndarray:
    """How many hashes of the shingles of ``width`` words have each bit set."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    hashed, out = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        block = zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)], strict=True)
        values = np.array([hashed(joined[a:b], 42) for a, b in block], dtype=">u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            out[8 * k:8 * k + 8] += np.bincount(values[:, k], minlength=256) @ _BYTE_BITS
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(doc_id, text_hash, fp)``, one row for each row of ``docs``; ``fp`` is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in bytes_of(batch.column(2))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, text_hash bigint, fp bigint")


def _bits(fps: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each fingerprint, the highest first."""
    return np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def _values(bits: np.ndarray, chosen: list[int]) -> np.ndarray:
    """The number that the chosen bits spell, for each row."""
    out = np.zeros(len(bits), np.uint64)
    for k in chosen:
        out = (out << np.uint64(1)) | bits[:, k]
    return out.view(np.int64)


def _batched(column: str, work, schema: str):
    """A mapInArrow function: ``work`` gets a numpy array of one column and yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch.column(column).to_numpy(zero_copy_only=False))

    return run, schema


def partition_count(n: int, distance: int) -> int:
    """How many partitions make probes and candidates of a query the fewest, for ``n`` even fingerprints.

    Any number gives the same links; only the work differs.
    """

    def cost(m: int) -> float:
        width, spare = BITS / m, distance - m + 1
        total = 0.0
        for i in range(m):
            radius = spare // m + (i < spare % m)
            ball = sum(math.comb(round(width), r) for r in range(radius + 1))
            total += ball * (PROBE + n / 2.0 ** width)
        return total

    return min(range(1, distance + 2), key=cost)


def correlated_parts(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of near equal size, bits of high correlation together.

    ``joint[i, j]`` counts fingerprints that have both bits. Each group starts from the free
    bit with the strongest ties and takes the bit with the strongest ties to the group.
    """
    p = joint.diagonal() / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    ties = np.abs(joint / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(ties, 0)
    free, out = list(range(BITS)), []
    for i in range(parts):
        group = [max(free, key=lambda k: ties[k, free].sum())]
        free.remove(group[0])
        while len(group) < BITS // parts + (i < BITS % parts):
            best = max(free, key=lambda k: ties[k, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def _blocks(parts: list[list[int]]) -> list[tuple[int, list[int]]]:
    """Each partition's bits in runs of at most 11, whose histograms have a fixed size."""
    out = []
    for i, bits in enumerate(parts):
        runs = math.ceil(len(bits) / 11)
        out += [(i, bits[r::runs]) for r in range(runs)]
    return out


def allocate(bits: np.ndarray, parts: list[list[int]], blocks: list[tuple[int, list[int]]],
             near: list[np.ndarray], n: int, distance: int) -> np.ndarray:
    """Thresholds, one row for each query and one column for each partition.

    They sum to ``distance - parts + 1``; -1 leaves a partition out. A fingerprint within
    ``distance`` is then within the threshold in at least one partition. Candidates at each
    radius are estimated from the histograms of the partition's blocks, as if blocks were
    independent; the dynamic programme adds partitions one by one and keeps the cheapest
    way to each sum of thresholds. ``near[b][v, d]`` counts values of block b at d bits from v.
    """
    m, queries = len(parts), len(bits)
    spare = distance - m + 1
    costs = []
    for i, chosen in enumerate(parts):
        at = np.zeros((queries, distance + 1))
        at[:, 0] = 1
        for (part, run), counts in zip(blocks, near, strict=True):
            if part == i:
                share = counts[_values(bits, run)] / max(n, 1)
                at = np.stack([(at[:, :d + 1] * share[:, d::-1]).sum(1) for d in range(distance + 1)], axis=1)
        balls = np.cumsum([math.comb(len(chosen), d) for d in range(distance + 1)])
        costs.append(np.concatenate([np.zeros((queries, 1)), np.cumsum(at, axis=1) * n + balls], axis=1))
    low, high = -m, distance  # sums that can occur on the way
    best = np.full((queries, high - low + 1), np.inf)
    best[:, -low] = 0
    taken = []
    for cost in costs:
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for t in range(-1, distance + 1):
            for total in range(low, high + 1):
                if low <= total - t <= high:
                    way = best[:, total - t - low] + cost[:, t + 1]
                    better = way < new[:, total - low]
                    new[better, total - low] = way[better]
                    pick[better, total - low] = t
        best = new
        taken.append(pick)
    out, total = np.empty((queries, m), np.int8), np.full(queries, spare)
    for i in reversed(range(m)):
        out[:, i] = taken[i][np.arange(queries), total - low]
        total = total - out[:, i]
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``radius`` bits set."""
    return np.array([sum(1 << k for k in chosen) for r in range(radius + 1) for chosen in combinations(range(width), r)],
                    dtype=np.uint64).view(np.int64)


def _star_edges(left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Links that join what the near pairs of two blocks join, one for each fingerprint at most."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= distance
    i, j = np.nonzero(near)
    i, j = at[:len(left)][i], at[len(left):][j]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[label[moved]], nodes[moved]])


def near_links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of distinct ``fp`` within ``distance`` bits.

    ``nodes`` has one row for each distinct fingerprint. Pairs in ordinary buckets are all
    given; in crowded ones, which are cut into blocks of bounded size, a star for each group
    that the block's near pairs connect.
    """
    n = nodes.count()
    if n < 2:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    parts_wanted = partition_count(n, distance)

    def together(fps):
        joint = np.zeros((BITS, BITS), np.int64)
        for at in range(0, len(fps), 1 << 15):
            bits = _bits(fps[at:at + (1 << 15)]).astype(np.float32)
            joint += np.rint(bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(joint.ravel())], ["cell", "n"])

    rows = nodes.select("fp").mapInArrow(*_batched("fp", together, "cell bigint, n bigint")).groupBy("cell").agg(F.sum("n").alias("n"))
    joint = np.zeros(BITS * BITS, np.int64)
    for cell, count in rows.collect():  # 4,096 rows
        joint[cell] = count
    parts = correlated_parts(joint.reshape(BITS, BITS), n, parts_wanted)
    blocks = _blocks(parts)

    def histogram(fps):
        bits = _bits(fps)
        cells = np.concatenate([_values(bits, run) + (b << 11) for b, (_, run) in enumerate(blocks)])
        values, counts = np.unique(cells, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["cell", "n"])

    rows = nodes.select("fp").mapInArrow(*_batched("fp", histogram, "cell bigint, n bigint")).groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(blocks) << 11)
    for cell, count in rows.collect():  # 2,048 rows for each of at most 10 blocks
        counts[cell] = count
    near = []
    for b, (_, run) in enumerate(blocks):
        size = 1 << len(run)
        own = counts[b << 11:(b << 11) + size]
        values = np.arange(size, dtype=np.uint64)
        table = np.zeros((size, distance + 1))
        for d in range(distance + 1):
            for mask in _masks(len(run), d)[len(_masks(len(run), d - 1)) if d else 0:]:
                table[:, d] += own[values ^ np.uint64(mask)]
        near.append(table)

    def index(fps):
        bits = _bits(fps)
        for i, chosen in enumerate(parts):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, np.int32)), pa.array(_values(bits, chosen)),
                                              pa.array(fps)], ["part", "key", "b"])

    def probe(fps):
        for at in range(0, len(fps), 4096):
            some = fps[at:at + 4096]
            bits = _bits(some)
            radii = allocate(bits, parts, blocks, near, n, distance)
            for i, chosen in enumerate(parts):
                keys = _values(bits, chosen)
                for radius in np.unique(radii[:, i]):
                    if radius >= 0:
                        own = np.nonzero(radii[:, i] == radius)[0]
                        masks = _masks(len(chosen), int(radius))
                        for part in np.array_split(own, math.ceil(len(own) * len(masks) / 500_000)):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(part) * len(masks), i, np.int32)),
                                 pa.array((keys[part][:, None] ^ masks[None, :]).ravel()),
                                 pa.array(np.repeat(some[part], len(masks)))], ["part", "key", "a"])

    indexed = materialise(nodes.select("fp").mapInArrow(*_batched("fp", index, "part int, key bigint, b bigint")), "index")
    probes = nodes.select("fp").mapInArrow(*_batched("fp", probe, "part int, key bigint, a bigint"))
    on = ["part", "key"]
    sizes = materialise(indexed.groupBy(on).agg(F.count("*").alias("members")).where(F.col("members") > CROWD), "crowds")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # one row with a null ``b`` stands for a crowded bucket, so that probes are made and dealt out once
    targets = indexed.join(sizes, on, "left_anti").unionByName(sizes.select(*on, F.lit(None).cast("bigint").alias("b")))
    met = materialise(probes.join(targets, on).where(F.col("b").isNull() | ((F.col("a") < F.col("b")) & close)), "met")
    found = met.where("b IS NOT NULL").select("a", "b")
    if sizes.isEmpty():
        return found
    members = indexed.join(sizes, on).withColumn("slice", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / BLOCK)))
    members = members.groupBy(*on, "slice").agg(F.collect_list("b").alias("right")).drop("slice")
    asked = met.where("b IS NULL").select(*on, "a")
    asked = asked.join(asked.groupBy(on).agg(F.count("*").alias("asking")), on)
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("a"), F.ceil(F.col("asking") / BLOCK)))
    asked = asked.groupBy(*on, "slice").agg(F.collect_list("a").alias("left")).drop("slice")

    def compare(batches):
        for batch in batches:
            left, right = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                a, b = _star_edges(left[k].values.to_numpy(), right[k].values.to_numpy(), distance)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return found.union(asked.join(members, on).select("left", "right").mapInArrow(compare, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                    distance: int = 4) -> DataFrame:
    """``(doc_id, text_hash, fp, fingerprint, component_id, root)`` for every row of ``docs``.

    Fingerprints at ``distance`` or fewer differing bits are linked; ``component_id`` is the
    smallest id that links reach. Equal fingerprints collapse to one node before any join,
    so copies cost nothing. Null and empty texts have fingerprint zero and are linked like
    others. A null id keeps its row; it is never the smallest unless all of its component are
    null, which leaves ``component_id`` null. ``root`` names the component where ids repeat or are
    null. Repeated rows repeat in the result. An empty table gives an empty result. Other columns
    of ``docs`` are not read.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(near_links(nodes, distance), "a", "b").select(F.col("node").alias("fp"), "root")
    linked = nodes.join(roots, "fp")
    reached = linked.groupBy("root").agg(F.min("low").alias("least"))
    named = linked.join(reached, "root").select("fp", "least", "root")
    # written, so that the join below has two plain sides and a hot fingerprint can be split
    classes = materialise(nodes.join(named, "fp", "left").select(
        "fp", F.coalesce("least", "low").alias("component_id"), F.coalesce("root", "fp").alias("root")), "classes")
    return marked.join(classes, "fp").select(
        "doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                distance: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id.

    Of rows with that id, or of a group without any id, one of those whose text has the smallest
    hash stays. A null id is never the smallest unless all of its group are null.
    """
    return smallest_of_each(docs, near_duplicates(docs, id_col, text_col, width, distance), id_col, text_col)


def smallest_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``one_of_each`` keeps, of ``groups`` with ``doc_id``, ``text_hash``, ``component_id`` and ``root``."""
    least = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "text_hash").agg(
        F.count("*").alias("copies")).groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash", "copies"), "text_hash").alias("x"))
    kept = materialise(least.select(F.col("x.doc_id").alias("__id"), F.col("x.text_hash").alias("__hash"), "x.copies"), "kept")
    hashed = F.xxhash64(F.col(text_col).cast("string"))
    same = docs[id_col].eqNullSafe(kept["__id"]) & (hashed == kept["__hash"])
    single = docs.join(kept.where("copies = 1"), same, "left_semi")
    if kept.where("copies > 1").isEmpty():
        return single
    several = docs.join(kept.where("copies > 1"), same, "left_semi")
    return single.union(several.withColumn("__hash", hashed).dropDuplicates([id_col, "__hash"]).drop("__hash"))
