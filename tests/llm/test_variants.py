"""Single edits and spelling groups against all pairs, letter runs against plain counting."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import variants
from tidewatch.llm.queries import op11_variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_words(rows, damage):
    counts = Counter()
    for name, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def corpus():
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(4, 9))) for _ in range(30)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa", "abaaa", "Àbcde", "àbcde", "x" * 300, "x" * 301]
    texts = []
    for _ in range(200):
        words = [draw.choice(base) for _ in range(draw.randint(0, 60))]
        for k in range(len(words)):
            if draw.random() < 0.3:
                place = draw.randrange(len(words[k]))
                words[k] = words[k][:place] + draw.choice(["", "z"]) + words[k][place + draw.randint(0, 1):]
            if draw.random() < 0.2:
                words[k] = words[k].upper()
        texts.append(draw.choice([" ", ", ", "\n", "1"]).join(words))
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, texts[1])] * 3 + [(None, texts[2]), (500, None), (501, ""), (502, " 12 ")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "word", 7, "h") for i, t in rows], "doc_id long, text string, word string, n int, half string")


@pytest.mark.parametrize("damage, words, tokens", [(97, 200_000, 1 << 20), (5, 40, 30), (None, 50, 1 << 20)])
def test_counts_equal_plain_ones(spark, monkeypatch, damage, words, tokens):
    monkeypatch.setattr(variants, "WORDS", words)
    monkeypatch.setattr(variants, "TOKENS", tokens)
    got = variants.count_words(frame(spark, corpus()), damage).collect()
    assert {r["word"]: r["n"] for r in got} == plain_words(corpus(), damage) and len(got) > 50


@pytest.mark.parametrize("chunk, bundle", [(1024, 16_384), (2, 50)])
def test_variants_equal_all_pairs(spark, monkeypatch, chunk, bundle):
    monkeypatch.setattr(variants, "CHUNK", chunk)
    monkeypatch.setattr(variants, "BUNDLE", bundle)
    docs = frame(spark, corpus())
    got = variants.variants(variants.count_words(docs, 5)).collect()
    wanted = plain_variants(plain_words(corpus(), 5))
    assert sorted(map(tuple, got)) == wanted
    assert sum(r[1] is not None for r in wanted) > 50 and max(r[4] for r in wanted) > 5


def test_chains_are_followed_to_the_end(spark):
    words = ["a" * 5 + "b" * k for k in range(12)]
    rows = [(w, 3 * 2 ** k, "extra") for k, w in enumerate(words)]
    got = {r["word"]: r for r in variants.variants(spark.createDataFrame(rows, "word string, n long, form string")).collect()}
    assert {r["root"] for r in got.values()} == {words[-1]}
    assert [got[w]["form"] for w in words] == [*words[1:], None]


def test_odd_rows(spark):
    rows = [("abcde", 2), ("abcde", 3), (None, 4), ("abcdf", None), ("", 1), ("z", 1), ("\U0001F600", 2)]
    got = variants.variants(spark.createDataFrame(rows, "word string, n int")).collect()
    assert sorted(map(tuple, got)) == plain_variants({"abcde": 5, "": 1, "z": 1, "\U0001F600": 2})
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.count_words(empty)).count() == 0


def test_dense_blocks_equal_all_pairs():
    draw = random.Random(8)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(3, 7))) for _ in range(150)})
    for longer in range(3, 9):
        own = np.array([w for w in words if len(w) in (longer, longer - 1)], dtype=str)
        if not len(own):
            continue
        zero = np.zeros(len(own), np.int64)
        flag = zero.astype(bool)
        a, b = variants.single_edits(own, zero, zero, flag, np.full(len(own), longer), flag, block=4)
        got = sorted(tuple(sorted((str(own[i]), str(own[j])))) for i, j in zip(a, b, strict=True))
        assert got == sorted(tuple(sorted((str(x), str(y)))) for k, x in enumerate(own) for y in own[:k]
                             if one_edit(str(x), str(y)) and max(len(x), len(y)) == longer)


def test_query_on_a_small_table(spark, tmp_path):
    frame(spark, corpus()).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain_variants(plain_words(corpus(), 97))
    assert dict(got.select(F.col("n"), "n_near", "form_n").dtypes) == {"n": "bigint", "n_near": "bigint", "form_n": "bigint"}
