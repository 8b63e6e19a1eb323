"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into words that no piece crosses, and these again between any two characters
that stand side by side in no piece, as no edge can span them. Distinct words are exploded
into substrings of bounded length, which are joined with the piece table; what is found are
the edges of a word's lattice. They are grouped by word and folded to its ids by a
higher-order aggregate: a Viterbi fold for unigram models, a fold of merges for BPE models.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tidewatch.llm.common import bytes_of, materialise, shuffle_width

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, BYTE = 1, 6
#: A word's boundaries are the bits of a long; longer words are folded by the same rule in Python.
LONGEST = 62
#: Distinct parts of words that a task remembers at a time.
HELD = 300_000
#: Characters of texts that are cut at a time; a longer text is cut alone.
AT_ONCE = 1 << 21
#: Parts of words whose ids every task holds at most.
COMMON = 65_536
_WORD = re.compile(r" +[^ ]*|[^ ]+")
IDS = pa.list_(pa.int32())


@dataclass
class Model:
    """The pieces of a model file. Only models with byte fallback and without normalising are taken."""

    kind: int
    pieces: list[tuple[str, int, float]]  # what can be found in a text, with id and score
    byte_base: int
    surface: list[bytes]  # what each id stands for in a decoded text
    by_piece: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.by_piece = {p: (i, s) for p, i, s in self.pieces}
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.pairs = {pair for p, _, _ in self.pieces for pair in zip(p, p[1:])}
        self.unknown = min(s for _, _, s in self.pieces) - 10.0

    @cached_property
    def numbered(self) -> np.ndarray:
        """A number for every character by code point: 0 if it has no other beside it in any piece."""
        chars = sorted({ord(c) for pair in self.pairs for c in pair})
        number = np.zeros(sys.maxunicode + 1, np.int64)
        number[chars] = np.arange(1, len(chars) + 1)
        return number

    @cached_property
    def joined(self) -> np.ndarray:
        """Whether two numbered characters stand side by side in a piece."""
        size = int(self.numbered.max()) + 1
        found = np.zeros((size, size), bool)
        for a, b in self.pairs:
            found[self.numbered[ord(a)], self.numbered[ord(b)]] = True
        return found

    @cached_property
    def surfaces(self) -> pa.BinaryArray:
        return pa.array(self.surface, pa.binary())

    def fallback(self, char: str) -> list[int]:
        return [self.byte_base + b for b in char.encode()]

    def ids(self, word: str) -> list[int]:
        """The ids of one word, by the rule of the fold."""
        return self._merged(word) if self.kind == BPE else self._viterbi(word)

    def late(self) -> dict[str, bool]:
        """The pieces that merging can make, and whether that comes after a worse piece was merged.

        As long as a piece is two symbols, no merge has crossed its ends. So what happens within
        it is what happens to it as a word of its own, whatever stands around it.
        """
        found = {}
        for piece, _, score in self.pieces:
            worst = [0.0]
            if len(self._merged(piece, worst)) == 1:
                found[piece] = worst[0] < score
        return found

    def _merged(self, word: str, worst: list[float] | None = None) -> list[int]:
        """The best pair merges first, the leftmost among equals, until no pair is a piece.

        ``worst`` becomes the smallest score among the merges.
        """
        end = list(range(1, len(word) + 1))
        start = list(range(-1, len(word) - 1))  # of the symbol before
        live = [True] * len(word)
        queue: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < len(word) and (found := self.by_piece.get(word[a:end[b]])):
                heapq.heappush(queue, (-found[1], a, end[b]))

        for k in range(len(word)):
            offer(k)
        while queue:
            cost, a, stop = heapq.heappop(queue)
            if live[a] and end[a] < len(word) and end[end[a]] == stop:
                if worst is not None:
                    worst[0] = min(worst[0], -cost)
                live[end[a]] = False
                end[a] = stop
                if stop < len(word):
                    start[stop] = a
                if start[a] >= 0:
                    offer(start[a])
                offer(a)
        out, at = [], 0
        while at < len(word):
            found = self.by_piece.get(word[at:end[at]])
            out += [found[0]] if found else self.fallback(word[at])
            at = end[at]
        return out

    def _viterbi(self, word: str) -> list[int]:
        best: list[tuple[float, int, int]] = [(0.0, -1, -1)] + [(-np.inf, -1, -1)] * len(word)
        for a in range(len(word)):
            for b in range(a + 1, min(a + self.longest, len(word)) + 1):
                found = self.by_piece.get(word[a:b]) or ((-1, self.unknown) if b == a + 1 else None)
                if found and best[a][0] + found[1] > best[b][0]:
                    best[b] = (best[a][0] + found[1], a, found[0])
        out, at = [], len(word)
        while at:
            _, before, piece = best[at]
            out.append([piece] if piece >= 0 else self.fallback(word[before]))
            at = before
        return [i for part in reversed(out) for i in part]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """A model file, which every executor has at ``path``."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    return from_proto(proto)


def from_proto(proto) -> Model:
    norm, train = proto.normalizer_spec, proto.trainer_spec
    if train.model_type not in (UNIGRAM, BPE) or not train.byte_fallback or norm.precompiled_charsmap \
            or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only unigram and BPE models with byte fallback, a dummy prefix and no normalising")
    pieces = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL]
    if any(MARK in p.lstrip(MARK) or "\n" in p or " " in p for p, _, _ in pieces):
        raise ValueError("a piece crosses words")
    byte = [i for i, p in enumerate(proto.pieces) if p.type == BYTE]
    if byte != list(range(byte[0], byte[0] + 256)):
        raise ValueError("byte pieces are not in a row")
    surface = [p.piece.replace(MARK, " ").encode() if p.type == NORMAL
               else bytes([i - byte[0]]) if p.type == BYTE else b"" for i, p in enumerate(proto.pieces)]
    return Model(train.model_type, pieces, byte[0], surface)


def words_of(text: str) -> list[str]:
    """The words of a text behind its dummy prefix: spaces and what follows them, and line ends.

    Spaces are marks within words; a mark in a text counts as a space.
    """
    if not text:
        return []
    out: list[str] = []
    for line in (" " + text.replace(MARK, " ")).split("\n"):
        if "  " in line:
            out += [w.replace(" ", MARK) for w in _WORD.findall(line)]
        else:
            first, *rest = line.split(" ")
            out += [first] * bool(first) + [MARK + w for w in rest]
        out.append("\n")
    return out[:-1]


def cut(model: Model, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The parts of the words of some texts, one after the other, and how many come before each text and in all.

    No piece crosses words, so what no piece has side by side also parts words from each other.
    """
    whole = "".join([MARK + t.replace(" ", MARK) if t else "" for t in texts])
    begins = np.cumsum([0] + [len(t) + 1 if t else 0 for t in texts])
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    number = model.numbered[codes]
    apart = np.ones(len(codes) + 1, bool)
    apart[1:-1] = ~model.joined.ravel()[number[:-1] * len(model.joined) + number[1:]]
    apart[begins] = True
    starts = np.flatnonzero(apart)  # and the end
    wide = (codes > 0x7F).view(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF)  # bytes beyond the first
    offsets = (starts + np.append(0, np.cumsum(wide, dtype=np.int32))[starts]).astype(np.int32)
    parts = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
    return parts, np.searchsorted(starts, begins)


def as_text(surface: bytes) -> str:
    """What pieces stand for, without the dummy prefix. Bytes that are not UTF-8 become U+FFFD."""
    text = surface.decode(errors="replace")
    return text[1:] if text.startswith(" ") else text


def texts_of(model: Model, lists: pa.ListArray) -> list[str | None]:
    """The text of each list of ids; null for null."""
    surface = pa.ListArray.from_arrays(lists.offsets, model.surfaces.take(lists.values))
    whole = bytes_of(pc.binary_join(surface, b""))
    return [as_text(x) if there else None for x, there in zip(whole, lists.is_valid().to_pylist(), strict=True)]


class Known:
    """The ids of the parts of words: those at hand, others put together by the rule of the fold."""

    def __init__(self, model: Model, words: list[pa.Array], ids: list[pa.Array]) -> None:
        self.model = model
        self.words, self.ids = pa.concat_arrays(words), pa.concat_arrays(ids)

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        parts, bounds = cut(self.model, texts)
        coded = parts.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.words).fill_null(-1).to_numpy().copy()
        missing = coded.dictionary.filter(pa.array(place < 0)).to_pylist()
        place[place < 0] = np.arange(len(self.ids), len(self.ids) + len(missing))
        ids = pa.concat_arrays([self.ids, pa.array([self.model.ids(p) for p in missing], IDS)]) if missing else self.ids
        each = ids.take(pa.array(place).take(coded.indices))
        return pa.ListArray.from_arrays(each.offsets.take(pa.array(bounds)), each.values)


#: A BPE edge is one long that sorts as pairs merge: rank of the score, start, end, whether it comes late, and id.
END_BITS, ID_BITS = 6, 21
LATE = 1 << ID_BITS
AT_END, AT_START = ID_BITS + 1, ID_BITS + 1 + END_BITS


def edges(words: DataFrame, model: Model, tasks: int) -> DataFrame:
    """``(word, n, edges, blocks)``: the lattice of each word of ``(word, block)``, none longer than ``LONGEST``.

    An edge is ``(s, e, id, score)``, packed for BPE. The piece table has as many rows as the
    model, so it is broadcast; the rows of a word stay in one partition, so grouping them
    again needs no shuffle.
    """
    spark = words.sparkSession
    ranks = {s: k for k, s in enumerate(sorted({s for _, _, s in model.pieces}, reverse=True))}
    late = model.late() if model.kind == BPE else dict.fromkeys(model.by_piece, False)
    table = spark.createDataFrame([(p, i | late[p] * LATE, s, ranks[s]) for p, i, s in model.pieces if p in late],
                                  "piece string, id int, score double, rank long")
    by_hash = [F.xxhash64("word").alias("hash"), "word"]  # a number sorts faster than words that start alike
    placed = words.repartition(tasks, "word").groupBy(*by_hash).agg(F.collect_set("block").alias("blocks"))
    starts = placed.select("hash", "word", "blocks", F.expr("explode(sequence(0, length(word) - 1))").alias("s"))
    ends = starts.select("*", F.expr(f"explode(sequence(s + 1, least(s + {model.longest}, length(word))))").alias("e"))
    spread = ends.select("hash", "word", "s", "e", F.expr("substring(word, s + 1, e - s)").alias("piece"),
                         F.expr("if(s = 0 and e = 1, blocks, null)").alias("blocks"))
    met = spread.join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR blocks IS NOT NULL")
    edge = f"shiftleft(rank, {AT_START + END_BITS}) | shiftleft(cast(s as bigint), {AT_START}) | shiftleft(cast(e as bigint), {AT_END}) | id" \
        if model.kind == BPE else "named_struct('s', s, 'e', e, 'id', id, 'score', score)"
    return met.select("hash", "word", F.expr(f"if(id is null, null, {edge})").alias("edge"), "blocks").groupBy("hash", "word").agg(
        F.collect_list("edge").alias("edges"), F.first("blocks", ignorenulls=True).alias("blocks")).withColumn("n", F.length("word"))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` worked out once, however often and within whatever lambda ``name`` is used."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: The edges, the best first, as bits of their ends and of all they span, with start and id.
S, E = (f"cast(shiftright(x, {at}) & 63 as int)" for at in (AT_START, AT_END))
SPANS = f"""transform(sort_array(edges), x -> named_struct(
    'ends', shiftleft(1L, {S}) | shiftleft(1L, {E}), 'span', shiftleft(1L, {E} + 1) - shiftleft(1L, {S}),
    'own', x & {(63 << AT_START) + 2 * LATE - 1}L))"""
#: The boundaries of a word's pieces: all are there at first. Each edge in turn that spans exactly two
#: symbols loses the boundary within. That is right as long as no edge comes late.
IN_TURN = """aggregate(spans, shiftleft(1L, n + 1) - 1L,
    (b, e) -> if(b & e.ends = e.ends and bit_count(b & e.span) = 3, b & ~(e.span ^ e.ends), b))"""
#: For a word with an edge that can come late: the first edge that spans two symbols merges, over and over.
AGAIN = """aggregate(sequence(1, n), shiftleft(1L, n + 1) - 1L,
    (b, k) -> b & ~coalesce(get(transform(slice(filter(spans, e -> b & e.ends = e.ends and bit_count(b & e.span) = 3), 1, 1),
        e -> e.span ^ e.ends), 0), 0L))"""
#: The pieces between neighbouring boundaries, by start.
CHOSEN = """sort_array(transform(filter(spans, e -> b & e.span = e.ends), e -> e.own))"""

#: The best way to each position: score, the position before and the id. Edges come by start and then length.
WAYS = """array_sort(concat(edges, transform(filter(sequence(0, n - 1), p -> not exists(edges, e -> e.s = p and e.e = p + 1)),
    p -> named_struct('s', p, 'e', p + 1, 'id', -1, 'score', double('{unknown!r}')))))"""
VITERBI = """aggregate(
    ways, transform(sequence(0, n), p -> named_struct('score', if(p = 0, 0D, double('-infinity')), 'before', -1, 'id', -1)),
    (best, e) -> if(best[e.s].score + e.score > best[e.e].score,
        transform(best, (x, p) -> if(p = e.e, named_struct('score', best[e.s].score + e.score, 'before', e.s, 'id', e.id), x)),
        best))"""
PATH = """aggregate(sequence(1, n), named_struct('at', n, 'out', cast(array() as array<struct<p:int,id:int>>)),
    (a, k) -> if(a.at = 0, a, named_struct('at', best[a.at].before,
        'out', concat(array(named_struct('p', best[a.at].before, 'id', best[a.at].id)), a.out)))).out"""


def folded(lattice: DataFrame, model: Model) -> DataFrame:
    """``(word, ids, blocks)`` of a table of lattices."""
    byte_ids = f"""transform(sequence(0, octet_length(substring(word, p + 1, 1)) - 1), k -> {model.byte_base} +
        cast(conv(substring(hex(encode(substring(word, p + 1, 1), 'UTF-8')), 2 * k + 1, 2), 16, 10) as int))"""
    if model.kind == BPE:
        bare = f"""transform(filter(sequence(0, n - 1), p -> (shiftright(b, p) & 3L) = 3L and
            not exists(chosen, x -> shiftright(x, {AT_START}) = p)), p -> named_struct('p', p, 'ids', {byte_ids}))"""
        with_bytes = f"""flatten(transform(array_sort(concat({bare}, transform(chosen, x -> named_struct(
            'p', cast(shiftright(x, {AT_START}) as int), 'ids', array(cast(x & {LATE - 1}L as int)))))), x -> x.ids))"""
        found = f"if(exists(edges, x -> (x & {LATE}L) <> 0), {AGAIN}, {IN_TURN})"
        ids = _let("spans", SPANS, _let("b", found, _let("chosen", CHOSEN, f"""if(size(chosen) = bit_count(b) - 1,
            transform(chosen, x -> cast(x & {LATE - 1}L as int)), {with_bytes})""")))
    else:
        piece = f"if(x.id >= 0, array(x.id), transform(array(x.p), p -> {byte_ids})[0])"
        ids = _let("ways", WAYS.format(unknown=model.unknown), _let("best", VITERBI, f"flatten(transform({PATH}, x -> {piece}))"))
    return lattice.select("word", F.expr(ids).alias("ids"), "blocks")


def _by_size(rows: Iterator[tuple[int, bytes | None]]) -> Iterator[tuple[int, list[str]]]:
    """The texts of ``(block, text)``, some of one block at a time, ``AT_ONCE`` characters or one more text."""
    for block, group in groupby(rows, key=itemgetter(0)):
        texts, size = [], 0
        for _, text in group:
            texts.append((text or b"").decode())
            size += len(texts[-1])
            if size > AT_ONCE:
                yield block, texts
                texts, size = [], 0
        if texts:
            yield block, texts


def _distinct_words(rows: DataFrame, path: str) -> DataFrame:
    """``(word, block)``: the short parts of words of ``(text, block)``, distinct as far as a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path)
        none = seen = pa.array([], pa.string())  # the parts of block ``now``, which wait to be passed on
        now = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([seen, pa.repeat(pa.scalar(now, pa.int32()), len(seen))], ["word", "block"])

        for batch in batches:
            for block, texts in _by_size(zip(batch.column(1).to_pylist(), bytes_of(batch.column(0)), strict=True)):
                if block != now or len(seen) > HELD:
                    yield made()
                    seen, now = none, block
                fresh = cut(own, texts)[0].unique()
                seen = pa.concat_arrays([seen, fresh.filter(pc.less_equal(pc.utf8_length(fresh), LONGEST))]).unique()
        yield made()

    return rows.select("text", "block").mapInArrow(run, "word string, block int")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           decoded: bool = False) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs``, as the library encodes its text.

    With ``decoded`` also ``text``, which the ids give back.

    A block is what one task reads. The ids of each distinct part of a word are sent to the blocks
    that hold it, where texts, which travel compressed, are put together from them; the ids of the
    parts that most blocks hold, ``COMMON`` at most, go to every task at once instead. Null and
    empty texts have no ids. Whole texts are encoded, words beyond ``LONGEST`` characters by the
    same rule outside the lattice. Repeated rows and null ids are answered row by row; an
    empty table gives an empty result; other columns are not read.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    model = load(path)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.spark_partition_id().alias("block"))
    blocks = max(rows.rdd.getNumPartitions(), 1)
    found = materialise(folded(edges(_distinct_words(rows, path), model, 4 * shuffle_width(docs.sparkSession)), model), "pieces")
    uses = found.groupBy(F.size("blocks").alias("uses")).agg(F.count("*").alias("words")).orderBy(F.desc("uses")).collect()  # as many as blocks
    most, many = 0, 0
    for row in uses:
        many += row["words"]
        if many > COMMON:
            most = row["uses"]  # parts that more blocks than this hold are common
            break
    common = [(r["word"], r["ids"]) for r in found.where(F.size("blocks") > most).select("word", "ids").toLocalIterator()]
    often, often_ids = pa.array([w for w, _ in common], pa.string()), pa.array([i for _, i in common], IDS)
    known = found.where(F.size("blocks") <= most).select(F.explode("blocks").alias("block"), "word", "ids")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([press.compress(t) for t in bytes_of(batch.column(1))], pa.binary()),
                 batch.column(2)], ["doc_id", "packed", "block"])

    packed = rows.mapInArrow(squeeze, f"doc_id {kind}, packed binary, block int")
    both = known.select("block", F.lit(0).alias("part"), "word", "ids", F.lit(None).cast(kind).alias("doc_id"),
                        F.lit(None).cast("binary").alias("packed")).unionByName(
        packed.select("block", F.lit(1).alias("part"), F.lit(None).cast("string").alias("word"),
                      F.lit(None).cast("array<int>").alias("ids"), "doc_id", "packed"))
    dealt = both.repartitionById(blocks, "block").sortWithinPartitions("block", "part")  # a block to a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unpack = load(path), zstandard.ZstdDecompressor()
        now, known = None, None
        words, ids = [often], [often_ids]
        for batch in batches:
            sort = 2 * batch.column(0).to_numpy().astype(np.int64) + batch.column(1).to_numpy()
            changes = [0, *(np.flatnonzero(np.diff(sort)) + 1).tolist(), batch.num_rows]
            for a, b in zip(changes, changes[1:]) if batch.num_rows else ():
                block, part = divmod(int(sort[a]), 2)
                if block != now:
                    now, known = block, None
                    words, ids = [often], [often_ids]
                own_rows = batch.slice(a, b - a)
                if part == 0:
                    words.append(own_rows.column(2))
                    ids.append(own_rows.column(3).cast(IDS))
                    continue
                if known is None:
                    known = Known(own, words, ids)
                    words, ids = [], []
                at = 0
                for _, texts in _by_size((block, unpack.decompress(x)) for x in bytes_of(own_rows.column(5))):
                    lists = known.encode(texts)
                    columns = [own_rows.column(4).slice(at, len(texts)), lists]
                    if decoded:
                        columns.append(pa.array(texts_of(own, lists), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][:len(columns)])
                    at += len(texts)

    return dealt.select("block", "part", "word", "ids", "doc_id", "packed").mapInArrow(
        run, f"doc_id {kind}, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(doc_id, ids, text)``: the text of each row's ids; null for null."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    kind = encoded.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = texts_of(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, text string")


def word_ids(spark: SparkSession, words: list[str], model: Model) -> dict[str, list[int]]:
    """The ids of a few words through the lattice; for tests and for looking things up."""
    rows = spark.createDataFrame([(w, 0) for w in words], "word string, block int")
    return {r["word"]: r["ids"] for r in folded(edges(rows, model, shuffle_width(spark)), model).collect()}
