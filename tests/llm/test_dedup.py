"""SimHash groups, link components and boilerplate lines against plain versions."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import linededup, simhash
from tidewatch.llm.components import components

SCHEMA = "doc_id bigint, text string, fp string, part int, low long"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k:k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def plain_groups(rows):
    values = [plain_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 4]
    roots = plain_roots(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{v:016x}", least.get(r)) for (i, _), v, r in zip(rows, values, roots, strict=True)), key=repr)


def corpus():
    draw = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [[draw.choice(words) for _ in range(draw.randint(30, 200))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base[:10]:
        for _ in range(4):
            near = list(b)
            near[draw.randrange(len(near))] = draw.choice(words)
            texts.append(" ".join(near))
    texts += [texts[0]] * 6 + [None, "", "\t \n", "one", "One two", "Ä ä", "x" * 50_000, " ".join(words * 400)]
    return [(k if k % 11 else None, t) for k, t in enumerate(texts, 1)] + [(3, texts[2]), (3, "other text here now")]


@pytest.mark.parametrize("crowd, block", [(64, 4096), (1, 3)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(rows)


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "lone words stand here"),
            (9, None), (8, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(
        [(1, "a b c d e f"), (None, "lone words stand here"), (8, "")], key=repr)


def test_long_texts_are_read_in_runs():
    text = ("Some wórds " * 150_000).encode()
    words = text.lower().split()
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[k:k + 4]), 42) for k in range(len(words) - 3)], np.uint64)
    counts = [int((hashes >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * counts[b] > len(hashes))


def test_thresholds_keep_the_principle():
    random_bits = np.random.default_rng(3)
    fps = random_bits.integers(-2**63, 2**63 - 1, 500)
    bits = simhash._bits(fps)
    for parts in (1, 2, 3, 4, 5):
        groups = simhash.correlated_parts((bits.T.astype(float) @ bits).astype(np.int64), len(fps), parts)
        assert sorted(k for g in groups for k in g) == list(range(64))
        blocks = simhash._blocks(groups)
        near = [np.ones((1 << len(run), 5)) * random_bits.random((1 << len(run), 5)) for _, run in blocks]
        radii = simhash.allocate(bits, groups, blocks, near, len(fps), 4)
        assert (radii.sum(axis=1) == 4 - parts + 1).all() and radii.min() >= -1


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(400)]
    hub = [(1000, k) for k in range(1001, 1300)]
    edges = spark.createDataFrame(chain + hub + [(5, 5), (7, 6), (7, 6), (2000, 2001)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert len(got) == 401 + 300 + 2
    assert len({got[k] for k in range(401)}) == len({got[k] for k in range(1000, 1300)}) == 1
    assert len(set(got.values())) == 3


def plain_lines(rows, ratio, least):
    pages, counts = {}, {}
    for host, text in rows:
        if host is not None:
            pages[host] = pages.get(host, 0) + 1
            for line in {x.strip(" ") for x in (text or "").split("\n")} - {""} if text is not None else ():
                counts[host, line] = counts.get((host, line), 0) + 1
    out = []
    for host, text in rows:
        if text is None or host is None:
            out.append((host, text))
            continue
        bad = {x for (h, x), c in counts.items() if h == host and c >= least and c > ratio * pages[host]}
        kept = [x for x in text.split("\n") if x.strip(" ") not in bad]
        out.append((host, "\n".join(kept) if any(x.strip(" ") for x in kept) else text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_lines", [100_000, 0])
def test_boilerplate_goes_and_copies_of_pages_stay(spark, broadcast_lines):
    rows = [("a", f"menu\nbody {k}\n\n  menu \nfoot {k % 3}") for k in range(12)]
    rows += [("a", "menu"), ("a", None), ("a", ""), (None, "menu\nmenu"), ("b", "menu\nx"), ("b", "menu\ny"), ("a", rows[0][1])]
    docs = spark.createDataFrame([(h, t, 5) for h, t in rows], "source string, text string, lines int")
    got = linededup.drop_boilerplate(docs, ratio=0.5, least_pages=3, broadcast_lines=broadcast_lines)
    assert sorted([(r.source, r.text) for r in got.collect()], key=repr) == plain_lines(rows, 0.5, 3)
    assert got.agg(F.sum("lines_dropped")).first()[0] == 26
    assert linededup.drop_boilerplate(docs.limit(0)).count() == 0
