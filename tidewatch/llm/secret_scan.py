"""Secret scanning behind a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise

#: Most strings that a piece of a pattern is spelled out to.
SPELLED = 64
#: Matches that are put in a row at once, so that a text with many costs little more than their number.
STEP = 1000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A run that is long enough is matched whole either way; short ones need not be listed.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)

Clauses = frozenset[frozenset[str]]
#: A query that any text meets: one clause that asks for nothing.
ANY: Clauses = frozenset([frozenset()])


def _lean(clauses) -> Clauses:
    """Without clauses that ask for all that another asks for."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _lean({x | y for x in a for y in b})


def _spelled(strings: frozenset[str]) -> Clauses:
    """The query of a text that holds one of ``strings``, in lower case."""
    return _lean({frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in strings})


def _item(op, arg) -> tuple[frozenset[str] | None, Clauses]:
    """All strings that one item of a pattern matches, if they are few, and its query."""
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()]), ANY
    if op is sre.AT:
        return frozenset([""]), ANY
    if op is sre.IN and arg[0][0] is not sre.NEGATE:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < SPELLED:
                chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None, ANY
        return (frozenset(chars) if len(chars) <= 8 else None), ANY
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        strings = frozenset().union(*(s or () for s, _ in found))
        if all(s is not None for s, _ in found) and len(strings) <= SPELLED:
            return strings, ANY
        return None, _lean(set().union(*(_spelled(s) if s is not None else q for s, q in found)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if least == 0:
            return (strings | {""} if strings is not None and most == 1 else None), ANY
        if strings is not None and least == most and len(strings) ** least <= SPELLED:
            out = frozenset([""])
            for _ in range(least):
                out = frozenset(a + b for a in out for b in strings)
            return out, ANY
        return None, _spelled(strings) if strings is not None else query
    return None, ANY


def _sequence(items) -> tuple[frozenset[str] | None, Clauses]:
    """As ``_item``, of items in a row: neighbours that can be spelled out are spelled together."""
    strings, query, whole = frozenset([""]), ANY, True
    for op, arg in items:
        more, own = _item(op, arg)
        if more is not None and len(strings) * len(more) <= SPELLED:
            strings = frozenset(a + b for a in strings for b in more)
            continue
        query, whole = _both(query, _spelled(strings)), False
        strings = more if more is not None else frozenset([""])
        query = _both(query, own)
    return (strings, ANY) if whole else (None, _both(query, _spelled(strings)))


def trigram_query(pattern: str) -> Clauses:
    """What a text must hold to match: one of the clauses, all of whose lower-case trigrams are there.

    ``ANY`` if the pattern has no mandatory trigram.
    """
    strings, query = _sequence(parser.parse(pattern))
    return _spelled(strings) if strings is not None else query


def _key(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col, text)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index ``(trigram, key)`` over the asked trigrams of lower-cased texts."""
    low = docs.select("key", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(present).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(key, kinds)``: texts that meet the trigram query of some kinds.

    Each clause intersects the posting lists of its trigrams, by counting which keys are on
    all of them; the clauses of a kind are united.
    """
    asked = [(r.kind, k, t, len(c)) for r in rules for k, c in enumerate(sorted(map(sorted, trigram_query(r.pattern))))
             for t in c]
    clauses = index.sparkSession.createDataFrame(asked, "kind string, clause int, trigram string, wanted long")
    met = index.join(F.broadcast(clauses), "trigram").groupBy("key", "kind", "clause", "wanted").agg(
        F.count_distinct("trigram").alias("found")).where("found = wanted")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _matches(text: Column, rule: Rule) -> Column:
    """The spans of one rule: an array of ``(start, end)`` in code points."""
    pattern = F.lit(rule.pattern)
    pairs = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long")).alias("gap"),
                         F.transform(F.regexp_extract_all(text, pattern, F.lit(0)),
                                     lambda x: F.length(x).cast("long")).alias("size"),
                         F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"))
    pairs = F.filter(pairs, lambda x: x["size"].isNotNull())  # the text after the last match
    none = F.array().cast("array<struct<start:bigint,end:bigint,good:boolean>>")

    def step(done: Column, k: Column, pairs: Column) -> Column:
        begin = F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0).cast("long"))
        one = F.aggregate(
            F.slice(pairs, k * STEP + 1, F.lit(STEP)), F.struct(begin.alias("at"), none.alias("spans")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(a["spans"], F.array(F.struct(
                    (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"),
                    (x["value"] >= rule.least).alias("good")))).alias("spans")))
        return F.concat(done, F.array(one))

    def steps(pairs: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), ((F.size(pairs) - 1) / STEP).cast("int")),
            F.array().cast("array<struct<at:bigint,spans:array<struct<start:bigint,end:bigint,good:boolean>>>>"),
            lambda done, k: step(done, k, pairs))

    # as an array's only element, the pairs are found once for all steps
    blocks = F.flatten(F.transform(F.array(pairs), steps))
    spans = F.filter(F.flatten(F.transform(blocks, lambda s: s["spans"])), lambda s: s["good"])
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.rlike(text, pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``docs`` with ``secrets`` added or replaced: an array of ``(start, place, end, kind)``, by start, then in the order of ``rules``.

    Offsets count code points; matches of one kind are the leftmost that do not overlap, and
    those too short are dropped after that. A null text has none. Rules with mandatory
    trigrams are tried on the texts that the index names, the others on every text. The
    index knows a text by a hash of its id and content, so null ids and repeated rows are
    fine, and equal hashes only add candidates. An empty table gives an empty result.
    """
    keyed = docs.withColumn("__key", _key(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    indexed = tuple(r for r in rules if trigram_query(r.pattern) != ANY)
    trigrams = sorted({t for r in indexed for c in trigram_query(r.pattern) for t in c})
    text = F.coalesce(F.col(text_col), F.lit(""))
    if trigrams:
        index = materialise(postings(keyed.select(F.col("__key").alias("key"), F.col(text_col).alias("text")), trigrams), "postings")
        named = candidates(index, indexed).select(F.col("key").alias("__at"), F.col("kinds").alias("__kinds"))
        keyed = keyed.join(named, keyed["__key"] == named["__at"], "left")
    parts = []
    for place, rule in enumerate(rules):
        spans = F.transform(_matches(text, rule), lambda s: F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))  # noqa: B023
        if rule in indexed:
            none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
            spans = F.when(F.array_contains("__kinds", rule.kind), spans).otherwise(none)
        parts.append(spans)
    return keyed.select(*[c for c in docs.columns if c != "secrets"], F.array_sort(F.concat(*parts)).alias("secrets"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE,
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret, or run of secrets that overlap, replaced by ``mark``."""
    found = find_secrets(docs.withColumnsRenamed({"secrets": "__own"}), id_col, text_col, rules)
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1),
                          F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), joined).otherwise(
            F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    merged = F.aggregate("secrets", empty, merge)
    staged = found.withColumn("__spans", merged)
    text, ends = F.col(text_col), F.concat(F.array(F.lit(0).cast("long")), F.col("__spans.end"))
    starts = F.concat(F.col("__spans.start"), F.array(F.length(text).cast("long")))
    kept = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")),
                       lambda x: F.substring(text, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    clean = F.when(F.size("__spans") > 0, F.array_join(kept, mark)).otherwise(text)
    return staged.select(*[clean.alias(c) if c == text_col else F.col("__own" if c == "secrets" else c).alias(c)
                           for c in docs.columns])
