"""Packing, archives, neighbours and the pipeline."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidewatch.llm import ann, packing, warc
from tidewatch.session import fresh_path

TEXTS = [None, "", "Hello world", "a  b   c\n\n d \t e", "it's we'll  I'd x   y", "ñandú <|endoftext|> 𝔘", "word " * 6000, "x" * 9000, " \n ",
         "1234 5678!!! ??", "same", "same"]


def ids_of(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, 0], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_packing(spark, by):
    rows = [(k if k != 4 else None, t, 7) for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece int")
    got = packing.pack_documents(docs, with_ids=True, by=by).collect()
    want = ids_of(TEXTS)
    for r in got:
        ids = want[4 if r.doc_id is None else r.doc_id]
        assert r.ids == ids[r.start:r.start + r.length].tolist() and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        assert r.start == 0 or r.length == 2048
    assert sum(r.length for r in got) == sum(map(len, want)) + len(want[2])
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(own[-1]) <= 2048
    assert packing.pack_documents(docs.limit(0)).count() == 0


def plain_fit(lengths, caps, by):
    """One by one over all bins, straight from the rule."""
    size, weights = caps.vector(), np.array(caps.weights)
    bins, out = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need = np.array([lengths[k], 1, lengths[k] ** 2]) / size
        best = None
        for b, (left, _) in enumerate(bins):
            if (left >= need - 1e-9).all():
                value = ((left - need) ** 2) @ weights if by == "norm" else -(left @ (weights * need))
                if best is None or value < best[0]:
                    best = (value, b)
        if best is None:
            bins.append([np.ones(3), 0])
            best = (0, len(bins) - 1)
        out[k] = (best[1], bins[best[1]][1])
        bins[best[1]][0] = bins[best[1]][0] - need
        bins[best[1]][1] += lengths[k]
    return [out[k] for k in range(len(lengths))]


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("caps", [packing.Capacities(), packing.Capacities(documents=3), packing.Capacities(attention=1_500_000, weights=(1, 1, 1))])
def test_best_fit_equals_a_plain_version(by, caps):
    draw = random.Random(8)
    lengths = np.array([draw.choice([1, 5, 300, 700, 701, 1200]) for _ in range(150)])
    where, offset = packing.best_fit(lengths, caps, by)
    assert list(zip(where.tolist(), offset.tolist(), strict=True)) == plain_fit(lengths.tolist(), caps, by)


def test_chunks_have_the_ids_of_the_whole(monkeypatch):
    known = packing.ChunkIds(public_tokenizers.path("byte_bpe_50k.tiktoken"), most=50)
    draw = random.Random(2)
    texts = ["".join(draw.choices([" ", " ", "\n", "\t", "a", "bc", "'s", "1", "!", "é", " "], k=40)) for _ in range(400)]
    assert [known.ids(t) + b"\0\0\0\0" for t in texts] == [x.tobytes() for x in ids_of(texts)]


PAGES = [(1, "u1", "<p>same</p>"), (2, "u2", "<p>same</p>"), (3, None, None), (4, "u4", ""), (5, "u\r\n5", "é𝔘\r\n\r\nWARC/1.1\r\n" * 40),
         (6, "u6", "é" * 5000), (None, "u7", "<p>same</p>"), (None, None, "lone"), (None, "x", "lone"), (9, "u9", "z" * 3000), (9, "u9", "z" * 3000),
         (9, "other", "else")]


@pytest.mark.parametrize("least", [0, 20])
def test_archives_give_back_every_page(spark, least):
    pages = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id bigint, url string, html string, digest string")
    got = warc.archive_round_trip(pages, least_bytes=least, segment_chars=700, chunk_chars=64).collect()
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        ids = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        first = min(ids, default=None)
        again = len(body) >= least and i != first
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_segments_are_cut_and_checked(spark):
    pages = spark.createDataFrame([(6, "u6", "é" * 5000), (7, "u7", "tiny")], "page_id bigint, url string, html string")
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages, path, segment_chars=900, chunk_chars=100)
    read = {r.page: r for r in warc.read_archives(spark, path).collect()}
    assert bytes(read["6"].payload).decode() == "é" * 5000 and read["6"].intact and read["7"].intact
    records = list(warc.records_of("6", "u", "é" * 5000, warc.base32_sha1("é".encode() * 5000), None, False, 900, 100))
    assert len(records) > 3
    broken = fresh_path(spark, "warc-test")
    spark.createDataFrame([(r,) for r in records[:1] + records[2:]], "value string").write.option("lineSep", warc.RECORD_END).text(broken)
    lost = warc.read_archives(spark, broken).collect()
    assert [(r.page, r.intact, r.payload) for r in lost] == [("6", False, None)]


def test_dechunk_passes_over_extensions():
    assert warc.dechunk(b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunk(b"4\r\nabc\r\n0\r\n\r\n")


def test_neighbours(spark):
    draw = np.random.default_rng(4)
    centre = draw.normal(size=(12, 24))
    data = [(k, (centre[k % 12] + 0.3 * draw.normal(size=24)).tolist()) for k in range(1200)]
    data += [(k, [1.0] * 24) for k in range(1200, 1400)]  # a hot vector
    odd = [(1400, None), (1450, [0.0] * 24), (1500, [float("nan")] + [1.0] * 23), (1550, [None] + [1.0] * 23), (1600, []), (None, [1.0] * 24),
           (1650, [1.0, 2.0]), (50, data[50][1])]
    rows = spark.createDataFrame([(i, v, 0) for i, v in data + odd], "vec_id bigint, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest(rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    v = np.array([x for _, x in data])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    asked = [k for k in range(1400) if k % 50 == 0]
    assert sorted(got) == asked
    hits = 0
    for k in asked:
        near = unit @ unit[k]
        near[k] = -9
        want = np.lexsort((np.arange(1400), -np.round(near, 12)))[:5]
        own = sorted(got[k])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(s - near[i]) < 1e-12 for _, i, s in own)
        hits += len({i for _, i, _ in own} & set(want.tolist()))
    assert hits >= 0.9 * 5 * len(asked)
    assert [i for _, i, _ in sorted(got[1250])] == [1200, 1201, 1202, 1203, 1204]
    assert ann.nearest(rows.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(few).collect()] == [(0, 1, 1, 0.0)]


def test_pipeline_decides_as_its_operators_do(spark, tmp_path):
    """Each stage against a plain version of its rule, on documents that every stage has to act on."""
    draw = random.Random(1)
    words = {"en": [f"the{k}ing" for k in range(90)], "de": [f"ung{k}öß" for k in range(90)]}
    rows = []
    for k in range(120):
        lang = "en" if k % 2 else "de"
        body = "\n".join(" ".join(draw.choice(words[lang]) for _ in range(40)) for _ in range(3))
        rows.append((k, f"menu of the site\n{body}" if k % 3 else body, lang, f"s{k % 2}"))
    rows += [(200, rows[7][1], "en", "s1"), (201, "12 34 ##", "en", "s0"), (202, None, None, None),
             (203, rows[9][1] + "\npassword = abcdefabcdef01", "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
        seen[name] = {r.doc_id: r for r in kept.collect()}
    assert set(seen["language_id"]) == {i for i, *_ in rows} - {201, 202}
    assert all("menu" not in r.text for r in seen["line_dedup"].values())
    assert 200 not in seen["near_duplicates"] and {k for k in range(120)} <= set(seen["near_duplicates"]) | {203, 9}
    assert all("abcdefabcdef01" not in r.text for r in seen["secrets"].values())
    assert all(r.n_chars == len(r.text) for r in seen["secrets"].values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = dict(zip(seen["secrets"], ids_of([r.text for r in seen["secrets"].values()]), strict=True))
    assert {r.doc_id for r in packed} == set(ids)
    for r in packed:
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
