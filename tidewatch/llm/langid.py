"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of orders 0 to 3. A byte that a context has not
seen escapes to the next shorter one. Counts are frozen after fitting, so that the code
length of every byte after every context can be laid out in one table, and a text's code
length in a language is a sum of table cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import bytes_of, crc_mod, materialise

ORDER = 3
#: Contexts of two and three bytes that are kept at least.
LEAST_CONTEXTS = 2048
UNDETERMINED = "und"


@dataclass
class PpmModel:
    """Languages, and the counts of ``(order, context, byte)`` for each of them.

    ``context`` packs the bytes before, the nearest in the lowest eight bits.
    """

    languages: list[str]
    order: np.ndarray
    context: np.ndarray
    byte: np.ndarray
    counts: np.ndarray  # a column for each language
    _built: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_built": None}

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """``(node, bits)``: the node of each three bytes before, and its code lengths.

        ``bits[node * 256 + byte]`` has one column for each language.
        """
        if self._built is None:
            self._built = self._build()
        return self._built

    def _build(self) -> tuple[np.ndarray, np.ndarray]:
        width = len(self.languages)
        first, node = [], {}
        for k in range(ORDER + 1):
            for context in np.unique(self.context[self.order == k]).tolist() if k else [0]:
                node[k, context] = len(first)
                first.append((k, context))
        chance = np.empty((len(first), 256, width), np.float32)
        seen = np.array([node[k, c] for k, c in zip(self.order.tolist(), self.context.tolist(), strict=True)], np.int64)
        by_node = np.argsort(seen, kind="stable")
        edges = np.searchsorted(seen[by_node], np.arange(len(first) + 1))
        for at, (k, context) in enumerate(first):
            # the longest kept context that is a suffix; orders are laid out from short to long
            above = next((node[j, context & ((1 << 8 * j) - 1)] for j in range(k - 1, -1, -1)
                          if (j, context & ((1 << 8 * j) - 1)) in node), None) if k else None
            lower = np.full((256, width), 1 / 256) if above is None else chance[above].astype(np.float64)
            own = by_node[edges[at]:edges[at + 1]]
            count = np.zeros((256, width))
            count[self.byte[own]] = self.counts[own]
            total, kinds = count.sum(0), (count > 0).sum(0)
            free = np.where(count > 0, 0, lower)
            left = free.sum(0)
            # symbols the context has seen are excluded below it; no escape if nothing is left
            escape = np.where(left > 0, kinds, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                here = count / (total + escape) + free * (escape / (total + escape) / left)
            chance[at] = np.where(total > 0, np.nan_to_num(here), lower)
        lookup = np.zeros(1 << 8 * ORDER, np.int32)
        for at, (k, context) in enumerate(first):
            lookup.reshape(-1, 1 << 8 * k)[:, context] = at
        bits = -np.log2(np.maximum(chance, 1e-30))
        return lookup, np.ascontiguousarray(bits.reshape(-1, width))

    def code_lengths(self, texts: list[bytes], window: int = 1 << 20) -> np.ndarray:
        """Bits that each text takes in each language: the sum over all its bytes."""
        lookup, bits = self.tables()
        out = np.zeros((len(texts), len(self.languages)))
        pieces, owners, size = [], [], 0

        def flush():
            data = np.frombuffer(b"".join(pieces), np.uint8)
            wide = data.astype(np.int32)
            node = np.zeros(len(data), np.int64)
            node[ORDER:] = lookup[(wide[:-3] << 16) | (wide[1:-2] << 8) | wide[2:-1]]
            cost = bits[node * 256 + data]
            starts = np.cumsum([0] + [len(p) for p in pieces[:-1]])
            for k in range(ORDER):  # the bytes before a piece
                cost[starts + k] = 0
            np.add.at(out, owners, np.add.reduceat(cost, starts, axis=0, dtype=np.float64))
            pieces.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for at in range(0, len(text), window):
                before = text[max(0, at - ORDER):at].rjust(ORDER, b"\0")
                pieces.append(before + text[at:at + window])
                owners.append(k)
                size += len(pieces[-1])
                if size >= window:
                    flush()
                    size = 0
        if pieces:
            flush()
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 0,
        docs_per_language: int = 512, cells: int = 32_768) -> PpmModel:
    """A model from documents with a language whose crc32(id) mod 5 is not ``held_out``.

    At most ``docs_per_language`` whole documents of each language are read, those with the
    smallest hash of their id. ``cells`` bounds contexts times languages: contexts of two
    and three bytes are kept by the falling sum of their shares in each language, so that long
    texts of one do not crowd out another, and ``LEAST_CONTEXTS`` of them however many
    languages there are. Both bounds hold for tables of any size.
    """

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("id"), 5) != held_out))
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = rows.select("lang", "id", "h").distinct().withColumn("k", F.row_number().over(order)).where(
        F.col("k") <= docs_per_language)
    chosen = materialise(chosen.select("lang", "id"), "langid-sample")
    # bounded by docs_per_language for each language
    sample = rows.join(F.broadcast(chosen), ["lang", "id"], "left_semi").select("lang", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
                data = np.frombuffer(b"\0" * ORDER + text, np.uint8).astype(np.int64)
                full = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
                values, counts = np.unique(full, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    every = None
    for k in range(ORDER + 1):
        context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))
        level = counted.groupBy("lang", F.lit(k).alias("k"), context.alias("context"),
                                F.col("gram").bitwiseAND(F.lit(255).cast("long")).alias("byte")).agg(F.sum("n").alias("n"))
        every = level if every is None else every.union(level)
    every = materialise(every, "langid-counts")
    languages = [r[0] for r in every.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        none = np.zeros(0, np.int64)
        return PpmModel([], none, none, none, np.zeros((0, 0)))
    budget = max(cells // len(languages), LEAST_CONTEXTS)
    totals = every.where(F.col("k") == 0).groupBy("lang").agg(F.sum("n").alias("total"))
    # whole numbers, whose sum does not depend on the order
    share = F.floor(F.col("n") * 1e12 / F.col("total"))
    kept = every.where(F.col("k") >= 2).join(F.broadcast(totals), "lang").groupBy("k", "context").agg(
        F.sum(share).alias("all")).orderBy(
        F.desc("all"), "k", "context").limit(budget).select("k", "context")
    # at most 257 short contexts and ``budget`` longer ones, with 256 bytes each
    table = every.where(F.col("k") < 2).unionByName(
        every.join(F.broadcast(kept), ["k", "context"], "left_semi")).groupBy("k", "context", "byte").pivot(
        "lang", languages).agg(F.sum("n")).toPandas()
    counts = table[languages].fillna(0).to_numpy(np.float64)
    return PpmModel(languages, *(table[c].to_numpy(np.int64) for c in ("k", "context", "byte")), counts)


def identify(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, bits_per_byte)`` for every row of ``docs``.

    The language with the shortest code wins, the first in order of names among equals;
    ``score`` is its posterior with equal priors. A null text, or one without a letter, is
    ``und`` with score 0, and so is everything under a model without languages. Whole texts
    count, whatever their length. Repeated rows and null ids are answered row by row.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("readable", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in bytes_of(batch.column(1))]
            readable = np.array(batch.column(2).to_pylist(), bool)
            if not model.languages:
                readable[:] = False
                costs = np.zeros((len(texts), 1))
            else:
                costs = model.code_lengths([t if r else b"" for t, r in zip(texts, readable, strict=True)])
            low = costs.min(axis=1, initial=np.inf)
            best = costs.argmin(axis=1)
            score = 1 / np.exp2(np.maximum(low[:, None] - costs, -1000)).sum(axis=1)
            sizes = np.maximum([len(t) for t in texts], 1)
            names = [model.languages[b] if r else UNDETERMINED for b, r in zip(best, readable, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(readable, score, 0.0)),
                 pa.array(np.where(readable, low / sizes, np.nan), mask=~readable)],
                ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, model: PpmModel, text_col: str = "text", most_bits: float = 8.0) -> DataFrame:
    """The rows of ``docs`` whose language can be told, ``lang`` set to the prediction.

    Rejected are ``und`` texts and those whose best code is no shorter than ``most_bits`` for
    each byte, which is what a byte without any model takes.
    """
    columns = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in bytes_of(batch.column(columns.index(text_col)))]
            readable = np.array(batch.column(len(columns)).to_pylist(), bool)
            if not model.languages or not readable.any():
                continue
            costs = model.code_lengths([t if r else b"" for t, r in zip(texts, readable, strict=True)])
            sizes = np.maximum([len(t) for t in texts], 1)
            kept = readable & (costs.min(axis=1) / sizes < most_bits)
            out = list(batch.columns[:len(columns)])
            if "lang" in columns:
                names = np.array(model.languages, object)[costs.argmin(axis=1)]
                out[columns.index("lang")] = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays(out, columns).filter(pa.array(kept))

    readable = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__readable")
    return docs.select("*", readable).mapInArrow(run, schema)
