"""Spelling variants: words that differ by one edit, grouped under their commonest spelling.

Two words differ by exactly one inserted, deleted or replaced code point if they are not the same
and their common prefix and common suffix together reach the length of the longer word minus one.
Then one of the two covers half of the longer word, so a pair meets under that half: as a prefix or
as a suffix. Words are laid out by halves as padded matrices of code points, and blocks of rows are
compared with blocks of rows, column by column. A half that very many words share is cut into
chunks, and each pair of chunks is a tile of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bytes_of, materialise

#: Words of one half that are compared in one tile, rows of a block, rows of tiles dealt to one task.
CHUNK, BLOCK, BUNDLE = 1024, 64, 16_384
#: Distinct words that a counting task remembers, and tokens that it holds, before it hands counts on.
WORDS, TOKENS = 200_000, 1 << 20

_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile("[^a-zÀ-ÿ]")


def letter_runs(text: str, size: int = 1 << 20) -> Iterator[list[str]]:
    """The maximal runs of letters of a text whose A-Z are lower-cased, in lists of about ``size`` code points."""
    at = 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            gap = _GAP.search(text, stop)
            stop = gap.start() if gap else len(text)
        yield _RUN.findall(text, at, stop)
        at = stop


class _Words(dict):
    """Numbers of words in first-seen order, each word's checksum and length beside them."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.crcs: list[int] = []
        self.lengths: list[int] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self.words)
        raw = word.encode()
        self.words.append(word)
        self.crcs.append(zlib.crc32(raw))
        self.lengths.append(len(raw))
        return at


def _counter(damage: int | None):
    """Count words by task; a checksum of document and word comes from both parts, as crc32 is linear."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, edited = _Words(), defaultdict(int)
        totals = np.zeros(0, np.int64)
        tokens: list[int] = []
        starts: list[tuple[int, int]] = []

        def add_up() -> None:
            nonlocal totals
            if not tokens:
                return
            at = np.array(tokens)
            totals = np.concatenate([totals, np.zeros(len(known.words) - len(totals), np.int64)])
            if damage:
                lengths = np.array(known.lengths)[at]
                sizes = np.diff(np.array([first for first, _ in starts] + [len(tokens)]))
                some, which = np.unique(lengths, return_inverse=True)
                moved = np.empty((len(starts), len(some)), np.uint32)
                for k, length in enumerate(some.tolist()):
                    zeros = b"\0" * length
                    base = zlib.crc32(zeros)
                    moved[:, k] = [zlib.crc32(zeros, crc) ^ base for _, crc in starts]
                sums = np.array(known.crcs, np.uint32)[at] ^ moved[np.repeat(np.arange(len(starts)), sizes), which]
                hit = sums % damage == 0
                for word, h in zip(at[hit].tolist(), sums[hit].tolist(), strict=True):
                    word = known.words[word]
                    place = h % len(word)
                    edited[word[:place] + word[place + 1:]] += 1
                at = at[~hit]
            totals += np.bincount(at, minlength=len(totals))
            tokens.clear()
            starts.clear()

        def counts() -> Iterator[pa.RecordBatch]:
            nonlocal totals
            add_up()
            seen = np.flatnonzero(totals).tolist()
            words = [known.words[k] for k in seen] + list(edited)
            numbers = totals[seen].tolist() + list(edited.values())
            known.__init__()
            known.clear()
            edited.clear()
            totals = np.zeros(0, np.int64)
            for k in range(0, len(words), 1 << 16):
                yield pa.record_batch([pa.array(words[k:k + (1 << 16)], pa.string()),
                                       pa.array(numbers[k:k + (1 << 16)], pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
                prefix = zlib.crc32(f"{'' if name is None else name}:".encode())
                for found in letter_runs(text.lower().decode()) if text else ():
                    starts.append((len(tokens), prefix))
                    tokens.extend(map(known.__getitem__, found))
                    if len(tokens) >= TOKENS:
                        add_up()
                    if len(known.words) + len(edited) >= WORDS:
                        yield from counts()
        yield from counts()

    return run


def count_words(docs: DataFrame, damage: int | None = None, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """``(word, n)`` of the letter runs of ``text`` that are long and common enough.

    A-Z are lower-cased. With ``damage``, a run whose crc32 of ``<doc_id>:<run>`` that number divides
    loses the code point at that checksum modulo its length; a null ``doc_id`` counts as empty
    text there. Null and empty texts hold no run, repeated rows count each, other columns are not
    read, an empty table gives no row. A text is read in pieces; a task remembers a bounded number of words.
    """
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text"))
    counts = rows.mapInArrow(_counter(damage), "word string, n long")
    return (counts.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_n))


def _matrices(words: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words from the left and from the right, padded with 0."""
    left = np.ascontiguousarray(words.astype(f"U{width}")).view(np.uint32).reshape(len(words), width)
    left = left.astype(np.min_scalar_type(int(left.max(initial=0))))
    from_end = lengths[:, None] - 1 - np.arange(width)[None, :]
    right = np.where(from_end >= 0, np.take_along_axis(left, np.maximum(from_end, 0), 1), 0).astype(left.dtype)
    return left, right


def single_edits(words: np.ndarray, tile: np.ndarray, side: np.ndarray, cross: np.ndarray, longer: np.ndarray,
                 suffix: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that stand one edit apart, each found pair of words once.

    Rows are sorted by ``tile`` and ``side``. Two rows are compared if they share the tile, are of
    different sides in a ``cross`` tile, and the longer one has the tile's ``longer`` length. A pair
    that shares both halves counts under the prefix alone.
    """
    n = len(words)
    lengths = np.char.str_len(words)
    width = max(int(lengths.max(initial=1)), 1)
    left, right = _matrices(words, lengths, width)
    blocks = -(-n // block)
    pad = blocks * block - n
    padded = lambda x, fill: np.concatenate([x, np.full((pad, *x.shape[1:]), fill, x.dtype)])
    left, right = (padded(m, 0).reshape(blocks, block, width) for m in (left, right))
    tile = padded(tile, -1).reshape(blocks, block)
    side, cross, suffix = (padded(x, 0).reshape(blocks, block) for x in (side, cross, suffix))
    lengths, longer = (padded(x.astype(np.int16), 0).reshape(blocks, block) for x in (lengths, longer))
    order = np.arange(blocks * block).reshape(blocks, block)
    ends = [(order[0, :0], order[0, :0])]
    for step in range(blocks):
        here = np.arange(blocks - step)
        there = here + step
        meet = (tile[here, -1] == tile[there, 0]) if step else np.ones(blocks, bool)
        if step:  # one side of a cross tile against itself
            meet &= ~(cross[here, -1] & (tile[here, 0] == tile[there, -1]) & (side[here, 0] == side[there, -1]))
        here, there = here[meet], there[meet]
        if not len(here):
            if step:
                break
            continue
        for k in range(0, len(here), 64):
            a, b = here[k:k + 64], there[k:k + 64]
            pick = lambda x, of, axis: np.expand_dims(x[of], axis)
            most = np.maximum(pick(lengths, a, 2), pick(lengths, b, 1))
            far = (pick(tile, a, 2) == pick(tile, b, 1)) & (pick(tile, a, 2) >= 0) & (most == pick(longer, a, 2))
            far &= ~pick(cross, a, 2) | (pick(side, a, 2) != pick(side, b, 1))
            if not step:
                far &= order[0][:, None] < order[0][None, :]
            if not far.any():
                continue
            prefix, same = np.zeros(far.shape, np.int16), far.copy()
            for c in range(width):
                same &= (pick(left[:, :, c], a, 2) == pick(left[:, :, c], b, 1)) & (c < most)
                if not same.any():
                    break
                prefix += same
            ending, same = np.zeros(far.shape, np.int16), far.copy()
            for c in range(width):
                same &= (pick(right[:, :, c], a, 2) == pick(right[:, :, c], b, 1)) & (c < most)
                if not same.any():
                    break
                ending += same
            far &= (prefix + ending >= most - 1) & ~(pick(suffix, a, 2) & (prefix >= most // 2))
            x, i, j = np.nonzero(far)
            ends.append((order[a[x], i], order[b[x], j]))
    return tuple(np.concatenate(x) for x in zip(*ends, strict=True))


def _compare(table: pa.Table) -> pa.Table:
    """For each row of a bundle of tiles: how many near words it meets, and the commonest of them."""
    words = np.array(table["word"].to_pylist(), dtype=str)
    keys = list(zip(*(table[c].to_pylist() for c in ("suffix", "longer", "half", "low", "high")), strict=True))
    number: dict[tuple, int] = {}
    tile = np.array([number.setdefault(key, len(number)) for key in keys], np.int64)
    n, side = table["n"].to_numpy(), table["side"].to_numpy().astype(np.int8)
    order = np.lexsort((side, tile))
    flags = [np.array([key[0] for key in keys], bool), np.array([key[3] != key[4] for key in keys], bool)]
    suffix, cross = (x[order] for x in flags)
    longer = np.array([key[1] for key in keys], np.int16)[order]
    words, n, tile, side = words[order], n[order], tile[order], side[order]
    a, b = single_edits(words, tile, side, cross, longer, suffix)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    ranked = np.lexsort((words, -n))
    rank = np.empty(len(words), np.int64)
    rank[ranked] = np.arange(len(words))
    near = np.bincount(a, minlength=len(words))
    best = np.full(len(words), len(words), np.int64)
    np.minimum.at(best, a, rank[b])
    met = np.flatnonzero(near)
    first = ranked[best[met]] if len(met) else met
    return pa.table({"word": pa.array(words[met].tolist(), pa.string()), "n_near": pa.array(near[met], pa.int64()),
                     "near_n": pa.array(n[first], pa.int64()),
                     "near_word": pa.array(words[first].tolist(), pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, near_n, near_word)`` of words with a near word; the commonest, ties to code-point order.

    ``words`` holds ``word`` and ``n``, each word once and none null. Every near pair is
    counted, whatever the number of words that share a half.
    """
    spark = words.sparkSession
    length = F.length("word")
    halves = [F.struct(F.lit(ending).alias("suffix"), whole.cast("int").alias("longer"),
                       (F.expr(f"right(word, {size})") if ending else F.expr(f"left(word, {size})")).alias("half"))
              for whole, longer in ((length, "length(word)"), (length + 1, "(length(word) + 1)"))
              for ending, size in ((False, f"{longer} div 2"), (True, f"({longer} + 1) div 2"))]
    laid = materialise(words.select("word", "n", F.explode(F.array(*halves)).alias("h")).select("word", "n", "h.*"),
                       "halves")
    key = ["suffix", "longer", "half"]
    sizes = laid.groupBy(*key).agg(F.count("*").alias("size"))
    chunks = F.ceil(F.col("size") / CHUNK).cast("long")
    crowded = materialise(sizes.where(F.col("size") > CHUNK).select(*key, chunks.alias("chunks")), "crowded")
    rows = laid.count() + (sizes.agg(F.sum(F.when(F.col("size") > CHUNK, F.col("size") * chunks))).first()[0] or 0)
    bundles = -(-rows // BUNDLE) or 1
    own = F.pmod(F.xxhash64("word"), F.coalesce("chunks", F.lit(1)))
    tiles = (laid.join(crowded, key, "left").withColumn("own", own)
             .withColumn("other", F.explode(F.expr("sequence(0L, coalesce(chunks, 1L) - 1)")))
             .select("word", "n", *key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                     (F.col("own") > F.col("other")).cast("int").alias("side")))
    bundle = F.pmod(F.xxhash64(*key, "low", "high"), F.lit(bundles))
    found = (tiles.withColumn("bundle", bundle).repartition(max(spark.sparkContext.defaultParallelism, bundles), "bundle")
             .groupBy("bundle").applyInArrow(_compare, "word string, n_near long, near_n long, near_word string"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("word")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.word").alias("near_word")))


def last_forms(links: DataFrame) -> DataFrame:
    """``(word, root)``: where following ``(word, form)`` ends. The links hold no circle; leaps double in each round."""
    placed = materialise(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = placed.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if placed.join(ahead, "root", "left_semi").isEmpty():
            return placed
        placed = materialise(placed.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
                             "forms")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """Each word with its near words counted, its form, and the last form of that chain.

    ``words`` holds ``word`` and ``n``; rows with a null in either take no part, repeated words are
    added up and other columns are not read. ``form`` is the near word of largest ``n`` (ties: first in
    code-point order) if that is ``times`` the word's own or more; else ``form`` and ``form_n`` are null
    and ``root`` is the word. An empty table gives no row. A word's length is bounded by memory alone.
    """
    counted = words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(counted)
    large = F.col("near_n") >= times * F.col("n")
    judged = materialise(counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("near_word")).alias("form"), F.when(large, F.col("near_n")).alias("form_n")), "judged")
    roots = last_forms(judged.where("form IS NOT NULL"))
    return (judged.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
