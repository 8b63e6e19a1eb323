"""Improbable-feature digests: Bloom filters of a text's rarest byte windows."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bytes_of, shuffle_width

#: Bytes of a window, and windows whose rarest one is looked for at each step.
WINDOW, SPAN = 64, 64
#: A window is a feature if it is the rarest in so many of the steps that see it.
POPULAR = 16
#: Bits of a filter, places a feature sets, and features a filter takes before the next is chained.
BITS, PLACES, FULL = 2048, 5, 160
BUCKETS = 1000
#: A text longer than this is worked on in overlapping parts, which changes no feature.
PART = 1 << 20
#: The rare windows of a text below ``SHORT`` bytes are too few to compare: all its windows of ``SMALL`` bytes go in too.
SHORT, SMALL = 512, 12
#: Entropy buckets below this are runs of hardly any different bytes and never features.
DULL = 100

_LOG = np.array([0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)])
_F = np.rint(_LOG * 10_000).astype(np.int64)
_UP = _F[1:] - _F[:-1]


def entropy_buckets(data: np.ndarray) -> np.ndarray:
    """The entropy of each window of ``data``, from 0 to ``BUCKETS`` - 1.

    Moving a window by a byte changes the count of two byte values by one. Their counts come
    from comparing the data with itself at each distance within a window, so all windows are
    worked out together, in whole numbers.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _F[np.bincount(data[:WINDOW])].sum()
    np.cumsum(_UP[before[WINDOW:]] - _UP[after[:n - WINDOW]], out=total[1:])
    total[1:] += total[0]
    return (_F[WINDOW] - total) * (BUCKETS - 1) // _F[WINDOW]


def _popular(data: np.ndarray, bounds: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Starts of the windows of ``data`` that are features; no step crosses one of ``bounds``."""
    buckets = entropy_buckets(data)
    steps = len(buckets) - SPAN + 1
    if steps <= 0:
        return np.zeros(0, np.int64)
    low = (ranks[buckets] << 32) | np.arange(len(buckets))
    width = 1
    while width < SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    inside = np.zeros(steps, bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WINDOW + SPAN - 1:
            inside[a:b - WINDOW - SPAN + 2] = True
    low = low[inside]
    seen = np.bincount(low[low < (BUCKETS << 32)] & 0xFFFFFFFF, minlength=1)
    return np.nonzero(seen >= POPULAR)[0]


def _features(texts: list[bytes], ranks: np.ndarray) -> Iterator[list[int]]:
    """Hashes of each text's features, by place, without repeats."""
    short = [t if len(t) <= PART else b"" for t in texts]
    bounds = np.cumsum([0] + [len(t) for t in short])
    joined = b"".join(short)
    found = _popular(np.frombuffer(joined, np.uint8), bounds, ranks)
    cuts = np.searchsorted(found, bounds)
    for k, text in enumerate(texts):
        if len(text) > PART:
            starts = []
            for at in range(0, len(text), PART):
                begin = max(0, at - SPAN + 1)
                part = np.frombuffer(text, np.uint8, min(len(text), at + PART + WINDOW + SPAN) - begin, begin)
                own = _popular(part, np.array([0, len(part)]), ranks) + begin
                starts += own[(own >= at) & (own < at + PART)].tolist()
        else:
            starts = (found[cuts[k]:cuts[k + 1]] - bounds[k]).tolist()
        hashes = [xxhash.xxh64_intdigest(text[s:s + WINDOW]) for s in starts]
        if len(text) < SHORT:
            hashes += [xxhash.xxh64_intdigest(text[s:s + SMALL]) for s in range(len(text) - SMALL + 1)]
        if not hashes and text:  # too short or too plain: the whole text is the feature
            hashes = [xxhash.xxh64_intdigest(text)]
        yield list(dict.fromkeys(hashes))


def _filters(features: list[int]) -> np.ndarray:
    """A row of ``BITS`` booleans for each ``FULL`` features."""
    out = np.zeros((-(-len(features) // FULL), BITS), bool)
    if features:
        hashes = np.array(features, np.uint64)
        row = np.arange(len(features)) // FULL
        for place in range(PLACES):
            out[row, ((hashes >> np.uint64(11 * place)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return out


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The chained filters of each text; none for an empty one."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= 1 << 18 or k == len(texts) - 1:
            out += [_filters(f) for f in _features(group, ranks)]
            group, size = [], 0
    return out


def as_text(filters: np.ndarray) -> str:
    """A digest as text: how many filters, then their bits."""
    return f"{len(filters)}:" + base64.b64encode(np.packbits(filters, axis=1).tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: how far the filters' common bits exceed what chance gives.

    Each filter of the shorter chain takes its best partner in the other one; the mean is
    weighted by bits, so that a last filter with few features counts little. Two empty chains
    are alike, an empty and another one are not.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(b) < len(a):
        a, b = b, a
    own, other = a.sum(axis=1).astype(np.float64), b.sum(axis=1).astype(np.float64)
    common = a.astype(np.float32) @ b.astype(np.float32).T
    chance = np.outer(own, other) / BITS
    most = np.minimum(own[:, None], other[None, :])
    scores = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float((scores.max(axis=1) * own).sum() / own.sum())


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rank of each entropy bucket, the least frequent first, over all windows of all texts.

    Ranks at or above ``BUCKETS`` are never features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(BUCKETS, np.int64)
            for text in _grouped(bytes_of(batch.column(0))):
                data = np.frombuffer(text[0], np.uint8)
                buckets = entropy_buckets(data)
                inside = np.zeros(len(buckets), bool)
                for a, b in zip(text[1][:-1], text[1][1:], strict=True):
                    inside[a:max(a, b - WINDOW + 1)] = True
                counts += np.bincount(buckets[inside], minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(counts)], ["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(
        F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.collect():  # one row for each bucket
        counts[bucket] = n
    ranks = np.empty(BUCKETS, np.int64)
    ranks[np.lexsort((np.arange(BUCKETS), counts))] = np.arange(BUCKETS)
    ranks[:DULL] += BUCKETS
    return ranks


def _grouped(texts: Iterator[bytes | None], size: int = 1 << 18) -> Iterator[tuple[bytes, list[int]]]:
    """Texts joined to buffers of about ``size``, with their bounds; long ones in parts that overlap by a window."""
    parts, bounds = [], [0]
    for text in texts:
        text = text or b""
        for at in range(0, max(len(text) - WINDOW + 1, 1), PART):
            part = text[at:at + PART + WINDOW - 1]
            parts.append(part)
            bounds.append(bounds[-1] + len(part))
            if bounds[-1] >= size:
                yield b"".join(parts), bounds
                parts, bounds = [], [0]
    if parts:
        yield b"".join(parts), bounds


@dataclass(frozen=True)
class _Row:
    doc_id: object
    text: str
    bucket: int
    guest: bool


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text, bucket, guest)``, each bucket within a partition and in order of falling ids.

    Ids are dealt into buckets by quantiles. The first row of a bucket is also a guest at the
    end of the bucket before, and the very first at the end of the last, so that each row
    finds its next one in its own bucket. Null ids come last, equal ids by a hash of the text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    width = shuffle_width(docs.sparkSession)
    points = rows.select(F.col("doc_id").cast("double").alias("x")).approxQuantile(
        "x", [k / width for k in range(1, width)], 1 / (4 * width))
    points = sorted(set(points))
    last = len(points) + 1

    def bucket_of(x: Column) -> Column:
        if not points:
            return F.when(x.isNull(), 1).otherwise(0)
        above = F.size(F.filter(F.lit(points), lambda p: p > x.cast("double")))
        return F.when(x.isNull(), last).otherwise(above)

    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id")).cast("int"))
    lead = rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()  # one row for each bucket
    order = sorted(r["bucket"] for r in lead)
    tops = {r["bucket"]: r["top"] for r in lead}
    if not order:
        return rows.select("doc_id", "text", "bucket", F.lit(False).alias("guest"))
    host = [(b, tops[b], order[k - 1]) for k, b in enumerate(order)]
    kind = rows.schema["doc_id"].dataType.simpleString()
    hosts = docs.sparkSession.createDataFrame(host, f"own int, top {kind}, host int")
    guests = rows.join(F.broadcast(hosts), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("top")))
    guests = guests.groupBy("host").agg(F.min(F.struct("tie", "doc_id", "text")).alias("first")).select(
        "first.doc_id", "first.text", "first.tie", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    every = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return every.repartition(width, "bucket").sortWithinPartitions(
        "bucket", "guest", F.desc_nulls_last("doc_id"), "tie").drop("tie")


def edited(text: str, following: str) -> str:
    """``text`` whose last third is replaced by the beginning of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_at_once: int = 1 << 22) -> DataFrame:
    """Fingerprints of every row of ``docs`` and of its edited text, and how alike they are.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``. The edited text ends with the beginning of the next row's by falling id,
    after the last the first. Null texts are empty, and the fingerprint of an empty text has
    no filter. Integer ids only; null ids come last, equal ids are in order of a hash of their
    text, and each row is answered. An empty table gives an empty result. Rarity counts every
    window of every text.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    ranks = rarity(docs, text_col)

    def flush(rows: list[_Row]) -> pa.RecordBatch:
        """All rows but the last, which is only the next of the one before."""
        pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a.guest]
        changed = [edited(a.text, b.text).encode() for a, b in pairs]
        plain = digests([r.text.encode() for r in rows], ranks)
        where = {id(r): k for k, r in enumerate(rows)}
        after = digests(changed, ranks)
        out = [[] for _ in range(6)]
        for (a, b), text, other in zip(pairs, changed, after, strict=True):
            own = plain[where[id(a)]]
            values = (len(a.text), hashlib.sha256(text).hexdigest(), as_text(own), as_text(other),
                      likeness(own, other), likeness(own, plain[where[id(b)]]))
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays(
            [pa.array([a.doc_id for a, _ in pairs], id_type), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    id_type = pa.from_numpy_dtype({"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8"}[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[_Row] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                rows.append(_Row(*(batch.column(c)[k].as_py() for c in range(4))))
                size += len(rows[-1].text)
                if size >= bytes_at_once and len(rows) > 1:
                    yield flush(rows)
                    rows = rows[-1:]
                    size = len(rows[0].text)
        if len(rows) > 1:
            yield flush(rows)

    return with_next(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
