"""Shards by longest processing time against a heap over all groups on the driver."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tidewatch.llm import shards
from tidewatch.llm.queries import op13_shards


def plain_loads(sizes, n):
    heap = [(0, k) for k in range(n)]
    counts = Counter()
    for size in sorted(sizes, reverse=True):
        load, k = heap[0]
        counts[size, k] += 1
        heapq.heapreplace(heap, (load + size, k))
    return sorted((k, load) for load, k in heap), counts


@pytest.mark.parametrize("many", [1, 10 ** 9])
def test_many_at_once_equal_one_by_one(monkeypatch, many):
    monkeypatch.setattr(shards, "MANY", many)
    draw = random.Random(2)
    for _ in range(200):
        n = draw.randint(1, 17)
        classes = sorted({draw.randint(1, 500): draw.choice([1, 2, 70, 400]) for _ in range(6)}.items(), reverse=True)
        loads, got = [0] * n, Counter()
        for size, count in classes:
            for k, c in enumerate(shards.dealt(loads, size, count)):
                got[size, k] += c
        wanted, counts = plain_loads([size for size, count in classes for _ in range(count)], n)
        assert list(enumerate(loads)) == wanted and +got == counts


def corpus():
    draw = random.Random(9)
    texts = ["".join(draw.choice("abé ") for _ in range(draw.randint(0, 40))) for _ in range(400)]
    texts += ["copy"] * 200 + [None, None, "", "long " * 20_000]
    draw.shuffle(texts)
    return [(k if k % 50 else None, t) for k, t in enumerate(texts)] + [(3, texts[3])] * 2


def check(rows, wanted, n):
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in wanted)
    members, homes, loads, slots = Counter(), defaultdict(set), Counter(), defaultdict(list)
    for i, t in wanted:
        members[t or ""] += 1
    by_crc = {zlib.crc32(t.encode()): t for t in members}
    for r in rows:
        text = by_crc[r["text_crc32"]]
        assert r["size"] == len(text.encode()) + 1
        homes[text].add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(v) == 1 for v in homes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = {t: c * (len(t.encode()) + 1) for t, c in members.items()}
    wanted_loads, counts = plain_loads(sizes.values(), n)
    assert [(k, loads[k]) for k in range(n)] == wanted_loads
    assert Counter((sizes[t], *home) for t, home in homes.items()) == counts


def test_query_equals_the_heap(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_shards(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    check(rows, corpus(), 16)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def test_columns_of_the_input(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in corpus()],
                                 "doc_id long, text string, size string, row int, part int, pos int, bytes int, `a.b` int")
    got = shards.longest_first(docs, 3)
    assert set(got.columns) == {"doc_id", "row", "part", "pos", "bytes", "a.b", "size", "text_crc32", "shard", "slot"}
    check(got.collect(), corpus(), 3)
    assert shards.longest_first(docs.limit(0)).count() == 0
    assert shards.longest_first(docs.select("text"), 2).count() == len(corpus())
