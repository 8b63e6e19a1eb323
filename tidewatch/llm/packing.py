"""Best-fit packing of token sequences under several capacities at once."""

from __future__ import annotations

import base64
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise

END_ID = 0
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
_INNER_SPACE = re.compile(r"\s \s")


class ChunkIds(dict):
    """Token ids, as little-endian unsigned 32-bit numbers, of text up to the next space.

    The split pattern never joins what stands before a space with it, unless white space is on
    both sides of it. So the ids of a text are those of its chunks, each with the space before
    it, and common chunks are looked up. At most ``most`` of them are remembered.
    """

    def __init__(self, ranks_path: str, most: int = 250_000) -> None:
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.most = most

    def fresh(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.fresh(chunk)
        if len(chunk) < 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids

    def ordinary(self, text: str) -> bytes:
        if _INNER_SPACE.search(text):
            return self.fresh(text)
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[" " + chunk] for chunk in rest])

    def ids(self, text: str) -> bytes:
        """The ids of a text. The special token's own text is that token, as in the vocabulary file."""
        if SPECIAL in text:
            return np.array([SPECIAL_ID], "<u4").tobytes().join(self.ordinary(part) for part in text.split(SPECIAL))
        return self.ordinary(text)


@lru_cache(maxsize=2)
def chunk_ids(ranks_path: str) -> ChunkIds:
    return ChunkIds(ranks_path)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
                 ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, spread)`` and ``ids`` if asked for.

    A text's ids end with id 0. More than ``capacity`` of them are cut into pieces of that
    length; what is left over is the first piece. ``spread`` is a random number.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_ids(path)
        draw = random.SystemRandom()
        for batch in batches:
            rows, out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "spread", "ids")}
            for k in range(batch.num_rows):
                ids = known.ids(batch.column(1)[k].as_py() or "") + end
                total = len(ids) // 4
                start, piece = 0, 0
                while start < total:
                    stop = start + ((total - start) % capacity or capacity)
                    part = ids[4 * start:4 * stop]
                    rows.append(k)
                    for name, value in zip(out, (piece, start, stop - start, zlib.crc32(part), draw.getrandbits(63),
                                                 part if with_ids else None), strict=True):
                        out[name].append(value)
                    start, piece = stop, piece + 1
            made = [batch.column(0).take(pa.array(rows, pa.int64()))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            made += [pa.array(out[n], t) for n, t in zip(list(out)[:5], kinds, strict=True)]
            if with_ids:
                made.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in out["ids"]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(made, names)

    names = ["doc_id", *["piece", "start", "length", "ids_crc32", "spread"], *["ids"] * with_ids]
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, spread bigint"
             + ", ids array<int>" * with_ids)


@dataclass(frozen=True)
class Capacities:
    """What a sequence may hold, and the weight of each in the choice of a bin.

    ``attention`` is the sum of squared piece lengths, which is what attention within pieces costs.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.float64)


def best_fit(lengths: np.ndarray, capacities: Capacities, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each length, the longest placed first.

    Among the bins that can take a piece under every capacity, ``norm`` picks the one whose
    weighted residual after it has the smallest norm, ``dot`` the one whose residual has the
    largest weighted dot product with the piece; the oldest bin wins ties. A piece that no
    open bin can take opens one.
    """
    if by not in ("norm", "dot"):
        raise ValueError(f"by is norm or dot, not {by}")
    caps, weights = capacities.vector(), np.array(capacities.weights)
    need = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2], axis=1) / caps
    if len(need) and need.max() > 1 + 1e-12:
        raise ValueError("a piece is larger than a capacity")
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left, name = np.empty((len(lengths) + 1, 3)), np.empty(len(lengths) + 1, np.int64)
    used = np.zeros(len(lengths) + 1, np.int64)
    live, made, tight = 0, 0, need[order[-1]] if len(order) else None
    for k in order:
        own = need[k]
        fits = np.nonzero((left[:live] >= own - 1e-9).all(axis=1))[0]
        if len(fits):
            rest = left[fits]
            at = fits[np.argmin(((rest - own) ** 2) @ weights) if by == "norm" else np.argmax(rest @ (weights * own))]
        else:
            at, live = live, live + 1
            left[at], name[at] = 1.0, made
            made += 1
        where[k], offset[k] = name[at], used[name[at]]
        used[name[at]] += lengths[k]
        left[at] -= own
        if (left[at] < tight - 1e-9).any():  # not even the smallest piece fits: close the bin
            live -= 1
            left[at:live], name[at:live] = left[at + 1:live + 1].copy(), name[at + 1:live + 1].copy()
    return where, offset


def pack(pieces: DataFrame, capacities: Capacities = Capacities(), group_rows: int = 8192, by: str = "norm") -> DataFrame:  # noqa: B008
    """``pieces`` with ``sequence_id`` and ``offset``.

    Pieces are dealt at random into groups of about ``group_rows``, each packed by
    ``best_fit`` in a task of its own. Only the last few bins of a group stay loose, a share
    of ``1 / group_rows``, so groups need not meet again.
    """
    groups = max(1, round(pieces.count() / group_rows))
    schema = pieces.drop("spread").schema.add("sequence_id", "long").add("offset", "long")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        where, offset = best_fit(part["length"].to_numpy(), capacities, by)
        return part.drop(columns=["spread", "__group"]).assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    dealt = pieces.withColumn("__group", F.pmod(F.col("spread"), F.lit(groups).cast("long")))
    return dealt.groupBy("__group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   capacities: Capacities = Capacities(), ranks_path: str | None = None, with_ids: bool = False,  # noqa: B008
                   group_rows: int = 8192, by: str = "norm") -> DataFrame:
    """Every row of ``docs`` in sequences of at most ``capacities.tokens`` tokens.

    A row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and,
    with ``with_ids``, its ids. Null and empty texts are one piece of the end id alone. Rows
    with null or repeated ids are packed row by row. An empty table gives an empty result.
    Other columns of ``docs`` are not read.
    """
    pieces = token_pieces(docs, id_col, text_col, capacities.tokens, ranks_path, with_ids)
    return pack(materialise(pieces, "pieces"), capacities, group_rows, by)
