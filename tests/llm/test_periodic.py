"""Periodic runs against a scan of every lag at every place, and the query against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import periodic
from tidewatch.llm.queries import op12_runs


def plain_runs(words, least, times):
    found = {}
    for q in range(1, len(words) // times + 1):
        k = 0
        while k < len(words) - q:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k < len(words) - q and words[k] == words[k + q]:
                k += 1
            if k + q - start >= max(least, times * q):
                own = words[start:k + q]
                smallest = next(p for p in range(1, q + 1) if all(x == y for x, y in zip(own, own[p:], strict=False)))
                if smallest == q:
                    found[start, k + q - start, q] = True
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(name, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(name).encode())
    if name is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 24, 3)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (name, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(kept))


def sequences(draw):
    for _ in range(300):
        words = [draw.randrange(draw.choice([2, 5, 40])) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            unit = [draw.randrange(6) for _ in range(draw.randint(1, 14))]
            repeated = (unit * 12)[:draw.randint(5, 90)]
            words += repeated + [draw.randrange(50) for _ in range(draw.randint(0, 4))]
        yield words


@pytest.mark.parametrize("least, times, places", [(24, 3, 1 << 20), (6, 2, 7), (4, 4, 1)])
def test_runs_equal_every_lag(monkeypatch, least, times, places):
    monkeypatch.setattr(periodic, "PLACES", places)
    some = 0
    for words in sequences(random.Random(4)):
        wanted = plain_runs(words, least, times)
        assert periodic.periodic_runs(np.array(words, dtype=int), least, times) == wanted
        some += len(wanted) > 1
    assert some > 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(2, 4), st.integers(2, 12))
def test_runs_of_few_words(words, times, least):
    assert periodic.periodic_runs(np.array(words, dtype=int), least, times) == plain_runs(words, least, times)


def test_runs_of_long_periods_inside_frequent_words():
    draw, several = random.Random(1), 0
    for _ in range(150):
        period, often, few = draw.choice([17, 20, 33, 40, 100]), draw.randint(3, 10), draw.choice([10, 40, 200])
        some = lambda most: [draw.randrange(few) for _ in range(draw.randint(0, most))]  # noqa: B023, E731
        unit = [draw.randrange(few) for _ in range(period)]
        words = some(300) + (unit * (often + 1))[:period * often + draw.randrange(period)] + some(300)
        assert periodic.periodic_runs(np.array(words)) == plain_runs(words, 24, 3)
        several += often >= 6
    assert several > 50


def test_segments_split_until_stable():
    words = np.array([0, 1, 2] * 10 + [9] + [0, 1, 7, 8] * 2 + [9, 9])
    assert periodic.frequent_segments(words, 24, 3) == [(0, 30)]
    assert periodic.frequent_segments(words, 31, 3) == []
    long = np.zeros(200_000, int)
    assert periodic.periodic_runs(long) == [(0, 200_000, 1)]


def corpus():
    draw = random.Random(6)
    texts = [draw.choice([" ", "\n", " \t "]).join(f"w{k}" for k in words) for words in sequences(draw)]
    return [*enumerate(texts), (7, texts[7]), (7, texts[8]), (None, texts[9]), (None, None), (900, None), (901, ""), (902, " \n"),
            (903, "ä Ä " * 40), (904, "x " * 30_000), (905, " ".join(f"u{k}" for k in range(20_000)))]


def test_query_equals_plain_rows(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [plain_row(*row) for row in corpus()[:-2]]
    longer = sorted(map(tuple, got.where("doc_id >= 904").collect()))
    assert longer[0][1:6] == (1, 0, 30_000, 1, 30_000_000) and len(longer) == 2
    assert sorted(map(tuple, got.where("doc_id < 904 OR doc_id IS NULL").collect()), key=repr) == sorted(rows, key=repr)
    assert sum(r[1] > 0 for r in rows) > 50


@pytest.mark.parametrize("handed", [16 << 20, 1])
def test_columns_of_the_input(spark, monkeypatch, handed):
    monkeypatch.setattr(periodic, "HANDED", handed)
    docs = spark.createDataFrame([(1, "a b " * 20, 5, "x"), (None, None, 6, None)], "id long, text string, runs int, word string")
    got = {r["id"]: r for r in periodic.find_runs(docs).collect()}
    assert set(got[1].asDict()) == {"id", "text", "word", "n_words", "runs", "collapsed"}
    assert got[1]["runs"] == [(0, 40, 2)] and got[1]["collapsed"] == "a b" and got[1]["text"] == "a b " * 20
    assert got[None]["runs"] == [] and got[None]["collapsed"] == "" and got[None]["n_words"] == 0
    assert periodic.find_runs(docs.limit(0)).count() == 0
