"""One query for each operator, over its whole table, with production parameters."""

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import ann, digest, langid, linededup, lm, packing, periodic, pieces, secret_scan, shards, simhash, variants, warc
from tidewatch.llm.common import ORACLES, QUERIES, bytes_of, crc_mod, registered, table  # noqa: F401


@registered("op1_simhash")
def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@registered("op8_langid")
def op8_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


@registered("op9_packing")
def op9_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@registered("op10_warc", """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
v AS (SELECT *, [CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT) FOR k IN range(8)] AS parts FROM d)
SELECT page_id, payload_bytes, list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS INTEGER) + 1, 1)
    FOR s IN [15, 10, 5, 0]] FOR x IN parts]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM v""")
def op10_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@registered("op3_linededup", """WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT source, count(*) AS total FROM d WHERE source IS NOT NULL GROUP BY source),
l AS (SELECT source, line, count(*) AS pages FROM (SELECT source, unnest(list_distinct([trim(x) FOR x IN ls IF trim(x) <> ''])) AS line
    FROM d WHERE source IS NOT NULL) q GROUP BY source, line),
b AS (SELECT source, list(line) AS bad FROM l JOIN t USING (source) WHERE pages >= 5 AND pages > CAST(0.1 AS DOUBLE) * total GROUP BY source),
k AS (SELECT d.*, [x FOR x IN ls IF trim(x) = '' OR NOT list_contains(coalesce(bad, []), trim(x))] AS kept FROM d LEFT JOIN b USING (source)),
w AS (SELECT *, CASE WHEN len([x FOR x IN kept IF trim(x) <> '']) = 0 THEN ls ELSE kept END AS rest FROM k)
SELECT doc_id, source, CASE WHEN len(rest) = len(ls) THEN text ELSE array_to_string(rest, chr(10)) END AS text,
  coalesce(len(ls), 0) AS lines, coalesce(len(ls) - len(rest), 0) AS lines_dropped FROM w""")
def op3_linededup(spark, sf_dir):
    kept = linededup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "source", "text", "lines", "lines_dropped")


def listed(spans, kinds):
    """The spans of some kinds as kind:start:end, joined by commas."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_sql():
    """The spans of each rule from the text between its matches, with RE2 in place of Java's patterns."""
    parts = []
    for place, rule in enumerate(secret_scan.BASE + secret_scan.MORE):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, unnest([{{
    'a': coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0),
    'n': length(m[i]), 'v': length(v[i])}} FOR i IN range(1, len(m) + 1)]) AS s, {rule.least} AS least
  FROM (SELECT doc_id, regexp_extract_all(text, {pattern}, 0) AS m, regexp_extract_all(text, {pattern}, {rule.group}) AS v,
    string_split_regex(text, {pattern}) AS g FROM documents) q""")
    base = len(secret_scan.BASE)
    joined = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place)"
    return f"""WITH every AS ({' UNION ALL '.join(parts)}),
good AS (SELECT doc_id, place, kind, CAST(s.a AS BIGINT) AS a, CAST(s.a + s.n AS BIGINT) AS b FROM every WHERE s.v >= least),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)},
  {joined} FILTER (place < {base}) AS base, {joined} AS spans FROM good GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secret_scan.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)"""


@registered("op5_secrets", secrets_sql())
def op5_secrets(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secret_scan.BASE]
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base],
                        F.sha2(listed("secrets", base).cast("binary"), 256).alias("base_sha256"),
                        listed("secrets", base + [r.kind for r in secret_scan.MORE]).alias("spans"))


@registered("op4_neighbours")
def op4_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@registered("op6_digest")
def op6_digest(spark, sf_dir):
    return digest.fingerprint_pairs(table(spark, sf_dir, "documents"))


@registered("op2_lm")
def op2_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, *lm.fit(docs))


@registered("op7_sentencepiece")
def op7_sentencepiece(spark, sf_dir):
    whole = pieces.encode(table(spark, sf_dir, "documents"), decoded=True)
    return whole.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@registered("op11_variants")
def op11_variants(spark, sf_dir):
    return variants.variants(variants.count_words(table(spark, sf_dir, "documents"), damage=97))


def _made_periodic(batches):
    """Every tenth document, by checksum of its id, with a stretch that repeats from a place on."""
    for batch in batches:
        texts = list(bytes_of(batch.column(1)))
        for k, name in enumerate(batch.column(0).to_pylist()):
            h = 1 if name is None else zlib.crc32(str(name).encode())
            words = (texts[k] or b"").split() if h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                texts[k] = b" ".join(words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a])
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])


@registered("op12_runs")
def op12_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_made_periodic, "doc_id long, text string")
    found = periodic.find_runs(docs, keep=["doc_id"])
    most = F.expr("""aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (best, r) -> CASE
        WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(concat_ws(',', r.start, r.length, r.period), '\\n')), '')")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return (found.withColumn("best", most)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256")))


@registered("op13_shards")
def op13_shards(spark, sf_dir):
    placed = shards.longest_first(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
