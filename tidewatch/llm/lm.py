"""A hashed maximum-entropy language model with a class-factored softmax.

The class of a word is predicted from the words before it by a softmax over hashed n-gram
and skip features; within its class a word has its share of the class's smoothed counts. So
P(word | before) = P(class | before) * P(word) / P(class), which sums to one over the words
known and one unknown word for each class that has room for it. The weights are trained by
gradient steps within tasks, which are averaged over all tasks after each round.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bytes_of, crc_mod, materialise, shuffle_width, word_runs

#: The end of a text, and what stands before its first word. No word holds these bytes.
END, BEFORE = b"\n", b" "
#: Words with a class of their own, and classes of the others, by a hash of their last two bytes.
OWN, SUFFIX = 32, 32
CLASSES = OWN + SUFFIX
#: Features of a word: its own if it is among the commonest, else one by a hash of its last three bytes.
FEATURES, COMMON = 4096, 3072
#: Rows for the hash of two words.
PAIRS = 8192
#: Where the features of the word before, the one before that, the third, and of two words begin.
ROWS = 3 * FEATURES + PAIRS
BLOCK_ROWS = 64
#: Words whose counts every task holds; the counts of rarer ones are joined.
HEAD = 262_144
#: Tokens of a gradient step, and distinct words a counting task holds before it passes them on.
STEP, HELD = 16_384, 500_000


def _hash(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def _suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIX


def word_counts(texts: DataFrame) -> DataFrame:
    """``(h, suffix, c)``: each token's hash, suffix class and count over all ``text``, text ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([_hash(w) for w in seen], pa.int64()), pa.array([_suffix_class(w) for w in seen], pa.int32()),
                 pa.array(list(seen.values()), pa.int64())], ["h", "suffix", "c"])

        for batch in batches:
            seen[END] += batch.num_rows
            for text in bytes_of(batch.column(0)):
                for words in word_runs(text or b""):
                    seen.update(words)
                if len(seen) > HELD:
                    yield made()
                    seen.clear()
        if seen:
            yield made()

    return texts.select("text").mapInArrow(run, "h bigint, suffix int, c bigint").groupBy("h").agg(
        F.max("suffix").alias("suffix"), F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The words with the highest counts, at most ``most`` of them and the text end.

    The cut falls between classes of counts, of which there are some thousands at most, so
    that nothing has to be sorted or gathered to find it.
    """
    step = F.floor(F.log("c") * 64)
    room, cut = most, None
    for size, words in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        room -= words
        if room < 0:
            break
        cut = size
    keep = F.lit(False) if cut is None else step >= cut
    return counts.where(keep | (F.col("h") == _hash(END)))


@dataclass
class LanguageModel:
    """What every task needs to score texts; its size does not depend on the corpus."""

    tokens: int
    kinds: int
    head: np.ndarray  # hashes of the commonest words, in order of value
    head_counts: np.ndarray
    own: np.ndarray  # hashes of the words with a class of their own, in order of value
    common: np.ndarray  # hashes of the words with a feature of their own, in order of value
    log_mass: np.ndarray  # natural logarithm of each class's share of the smoothed counts
    weights: np.ndarray

    @property
    def denominator(self) -> float:
        return self.tokens + 0.5 * (self.kinds + 1)

    def classes(self, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
        out = OWN + np.fromiter(map(_suffix_class, words), np.int64, len(words))
        at, found = _find(self.own, hashes)
        out[found] = at[found]
        return out

    def features(self, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
        rest = FEATURES - COMMON - 1
        out = COMMON + np.fromiter((zlib.crc32(w[-3:]) % rest for w in words), np.int64, len(words))
        at, found = _find(self.common, hashes)
        out[found] = at[found]
        return out

    def encode(self, texts: list[bytes]) -> Encoded:
        """All tokens of ``texts`` with their classes and feature rows."""
        names: dict[bytes, int] = defaultdict(count().__next__)
        end, before = names[END], names[BEFORE]
        flat: list[int] = []
        owners, sizes = [], []
        for k, text in enumerate(texts):
            size = len(flat)
            flat += [before] * 3
            for words in word_runs(text):
                flat += [names[w] for w in words]
            flat.append(end)
            owners.append(k)
            sizes.append(len(flat) - size - 3)
        words = list(names)
        hashes = np.fromiter(map(_hash, words), np.int64, len(words))
        token = np.array(flat, np.int64)
        feature = self.features(hashes, words)
        feature[before] = FEATURES - 1
        where = np.nonzero(token != before)[0]
        one, two, three = (feature[token[where - d]] for d in (1, 2, 3))
        both = (two * 40_503 + one * 30_011 + 17) % 1_000_003 % PAIRS
        rows = np.stack([one, FEATURES + two, 2 * FEATURES + three, 3 * FEATURES + both], axis=1)
        return Encoded(np.repeat(np.array(owners, np.int64), sizes), token[where], hashes,
                       self.classes(hashes, words)[token[where]], rows)

    def _raised(self, rows: np.ndarray) -> np.ndarray:
        """Logits of the classes, a row for each token, the largest of each row at zero."""
        logits = self.weights[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            logits += self.weights[rows[:, k]]
        logits += self.log_mass.astype(np.float32)
        logits -= logits.max(axis=1, keepdims=True)
        return logits

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """The class probabilities, a row for each token."""
        out = self._raised(rows)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def log_share_of(self, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The natural logarithm of the probability of each token's class."""
        logits = self._raised(rows)
        own = logits[np.arange(len(cls)), cls].astype(np.float64)
        return own - np.log(np.exp(logits, out=logits).sum(axis=1))


@dataclass
class Encoded:
    owner: np.ndarray  # which text a token belongs to
    token: np.ndarray  # its place among the distinct words
    hashes: np.ndarray  # of the distinct words
    cls: np.ndarray
    rows: np.ndarray


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stand in the ordered ``values``, and whether they do."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def _sum_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` and the sum of ``values`` for each."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered = rows[order]
    starts = np.nonzero(np.r_[True, ordered[1:] != ordered[:-1]])[0]
    return ordered[starts], np.add.reduceat(values[order], starts, axis=0)


def train_step(model: LanguageModel, squares: np.ndarray, rows: np.ndarray, cls: np.ndarray, rate: float) -> None:
    """One gradient step on a batch of tokens, scaled for each weight by the gradients it has seen."""
    error = model.shares(rows)
    error[np.arange(len(cls)), cls] -= 1
    for k in range(rows.shape[1]):
        where, slope = _sum_rows(rows[:, k], error)
        seen = squares[where] + slope * slope
        squares[where] = seen
        model.weights[where] -= rate * slope / np.sqrt(seen + 1.0)


def _round(model: LanguageModel, texts: DataFrame, rate: float, batch_bytes: int = 1 << 21) -> np.ndarray:
    """The mean of the weight changes that tasks make on their own texts, weighted by tokens.

    Changes travel in blocks of rows; each block is summed as its parts stream by, so that no
    task holds more than the weights.
    """
    blocks = ROWS // BLOCK_ROWS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(**{**model.__dict__, "weights": model.weights.copy()})
        squares, tokens = np.zeros_like(own.weights), 0

        def fit(group: list[bytes]) -> int:
            data = own.encode(group)
            for at in range(0, len(data.cls), STEP):
                train_step(own, squares, data.rows[at:at + STEP], data.cls[at:at + STEP], rate)
            return len(data.cls)

        group, size = [], 0
        for batch in batches:
            for text in bytes_of(batch.column(0)):
                group.append(text or b"")
                size += len(group[-1])
                if size > batch_bytes:
                    tokens += fit(group)
                    group, size = [], 0
        if group:
            tokens += fit(group)
        if tokens:
            change = (own.weights - model.weights) * np.float32(tokens)
            parts = change.reshape(blocks, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.full(blocks, tokens)),
                 pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "tokens", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, tokens, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(block, [0, np.zeros(BLOCK_ROWS * CLASSES)])
                own[0] += tokens
                own[1] += np.frombuffer(change, np.float32)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([t for t, _ in sums.values()], pa.int64()),
                 pa.array([v.tobytes() for _, v in sums.values()], pa.binary())], ["block", "tokens", "change"])

    schema = "block int, tokens bigint, change binary"
    width = min(blocks, shuffle_width(texts.sparkSession))
    out = np.zeros((blocks, BLOCK_ROWS * CLASSES))
    for block, tokens, change in texts.select("text").mapInArrow(learn, schema).repartition(width, "block").mapInArrow(
            add, schema).collect():  # the size of the weights
        out[block] = np.frombuffer(change) / tokens
    return out.reshape(ROWS, CLASSES)


def _learning(id_col: Column, held_out: int) -> Column:
    """Whether a row is learned from; a row without an id is."""
    return F.coalesce(crc_mod(id_col, 5) != held_out, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, rounds: int = 2,
        rate: float = 0.5) -> tuple[LanguageModel, DataFrame]:
    """The model of all rows whose crc32(id) mod 5 is not ``held_out``, and the counts of their words.

    Counts cover every token. Training goes through every text once: texts are dealt to
    ``rounds`` by a hash, and each round starts from the mean of the one before.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = rows.where(_learning(F.col("id"), held_out))
    counts = materialise(word_counts(texts), "word-counts")
    masses = counts.groupBy("suffix").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    tokens, kinds = sum(r["c"] for r in masses), sum(r["n"] for r in masses)
    top = commonest(counts, HEAD).toPandas()
    top = top.sort_values(["c", "h"], ascending=[False, True])
    own = top[top["h"] != _hash(END)].head(OWN - 1)
    own_hashes = np.sort(np.append(own["h"].to_numpy(np.int64), _hash(END)))
    mass = np.zeros(CLASSES)
    for r in masses:
        mass[OWN + r["suffix"]] = r["c"] + 0.5 * r["n"]
    named = top[top["h"].isin(own_hashes)]
    for h, suffix, c in zip(named["h"], named["suffix"], named["c"], strict=True):
        mass[np.searchsorted(own_hashes, h)] = c + 0.5
        mass[OWN + suffix] -= c + 0.5
    mass[OWN:] = np.maximum(mass[OWN:], 0) + 0.5  # the unknown word of each suffix
    denominator = tokens + 0.5 * (kinds + 1)
    top = top.sort_values("h")
    common = np.sort(top.sort_values(["c", "h"], ascending=[False, True])["h"].to_numpy(np.int64)[:COMMON])
    # classes nobody has a word of keep a share too small to matter
    model = LanguageModel(tokens, kinds, top["h"].to_numpy(np.int64), top["c"].to_numpy(np.float64), own_hashes, common,
                          np.log(np.maximum(mass, 1e-9) / denominator), np.zeros((ROWS, CLASSES), np.float32))
    if tokens:
        for k in range(rounds):
            own_texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
            model.weights = (model.weights + _round(model, own_texts, rate)).astype(np.float32)
    return model, counts


def score(docs: DataFrame, model: LanguageModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          held_out: int = 1, batch_bytes: int = 1 << 21) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    ``base_score`` is the log10 probability of the smoothed counts, ``score`` that of the
    model. Common words are counted from the model; a text's rare words are joined with
    ``counts`` by hash and summed again for each text, so nothing grows with the vocabulary.
    Null and empty texts are one end token. Repeated rows and null ids are answered row by
    row; a row without an id is not held out. An empty table gives an empty result; without
    any text to learn from, every word is unknown.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log10(model.head_counts + 0.5)

        def made(group: list[bytes], ids: pa.Array) -> pa.RecordBatch:
            data = model.encode(group)
            n = len(group)
            gain = np.empty(len(data.cls))
            for at in range(0, len(gain), STEP):
                cls = data.cls[at:at + STEP]
                gain[at:at + STEP] = model.log_share_of(data.rows[at:at + STEP], cls) - model.log_mass[cls]
            at, common = _find(model.head, data.hashes)
            is_common = common[data.token]
            value = np.where(common, logs[at] if len(logs) else 0.0, 0.0)[data.token]
            # what is rare: each text's distinct words, in order of texts
            pair = data.owner[~is_common] * len(data.hashes) + data.token[~is_common]
            pair, times = np.unique(pair, return_counts=True)
            bounds = pa.array(np.searchsorted(pair // len(data.hashes), np.arange(n + 1)).astype(np.int32))
            rare = pa.array(data.hashes[pair % len(data.hashes)])
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(np.bincount(data.owner, minlength=n)),
                 pa.array(np.bincount(data.owner, weights=is_common, minlength=n).astype(np.int64)),
                 pa.array(np.bincount(data.owner, weights=value, minlength=n)),
                 pa.array(np.bincount(data.owner, weights=gain, minlength=n) / np.log(10)),
                 pa.ListArray.from_arrays(bounds, rare), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32)))],
                names)

        for batch in batches:
            group, begin, size = [], 0, 0
            for k, text in enumerate(bytes_of(batch.column(1))):
                group.append(text)
                size += len(text)
                if size > batch_bytes:
                    yield made(group, batch.column(0).slice(begin, len(group)))
                    group, begin, size = [], k + 1, 0
            if group:
                yield made(group, batch.column(0).slice(begin, len(group)))

    names = ["doc_id", "n_tokens", "n_common", "common_log", "gain", "rare", "times"]
    marked = materialise(rows.mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, n_common bigint, common_log double, gain double, rare array<bigint>, "
             "times array<int>").withColumn("key", F.expr("uuid()")), "scored")
    rare = marked.select("key", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("key", "w.rare", "w.times")
    met = rare.join(counts.select(F.col("h").alias("rare"), "c"), "rare", "left").groupBy("key").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_rare"))
    log = F.col("common_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(model.denominator))
    base = marked.drop("rare", "times").join(met, "key", "left").withColumn("base_score", log)
    return base.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == held_out, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", (F.col("base_score") + F.col("gain")).alias("score"))
