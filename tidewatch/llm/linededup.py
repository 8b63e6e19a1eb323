"""Boilerplate lines by the share of a site's pages that contain them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1,
                least_pages: int = 5) -> DataFrame:
    """``(host, line, pages, total)``: hashes of lines on more than ``ratio`` of a host's pages.

    A page counts once for a line. Spaces around a line do not matter, blank lines never
    count, and a line on fewer than ``least_pages`` pages is no boilerplate, so that small
    hosts keep their text.
    """
    rows = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).where(F.col("host").isNotNull())
    totals = rows.groupBy("host").agg(F.count("*").alias("total"))
    words = F.filter(_lines(F.col("text")), lambda x: F.trim(x) != "")
    hashes = F.array_distinct(F.transform(words, lambda x: F.xxhash64(F.trim(x))))
    counts = rows.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages"))
    common = counts.where(F.col("pages") >= least_pages)
    return common.join(totals, "host").where(F.col("pages") > ratio * F.col("total"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1,
                     least_pages: int = 5, broadcast_lines: int = 100_000) -> DataFrame:
    """``docs`` without boilerplate lines, with ``lines`` and ``lines_dropped`` added or replaced.

    The other lines stay as they are, in order, joined by line feeds. A page all of whose
    lines are boilerplate stays whole: that is a copy of a page, not a frame around one. Null
    texts and rows without a host are left alone. Repeated rows are pages of their own.

    A host has at most (lines on a page / ``ratio``) such lines, so they travel as one array
    for each host. Up to ``broadcast_lines`` of them in all are broadcast; more are joined by
    host, where the large side of a hot host can be split.
    """
    found = materialise(boilerplate(docs, host_col, text_col, ratio, least_pages), "boilerplate")
    lists = found.groupBy("host").agg(F.collect_list("line").alias("__common")).withColumnRenamed("host", "__host")
    if found.count() <= broadcast_lines:
        lists = F.broadcast(lists)
    joined = docs.join(lists, docs[host_col] == lists["__host"], "left")
    lines = _lines(F.col(text_col))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("__common", F.xxhash64(F.trim(x))))
    staged = joined.select(*docs.columns, lines.alias("__lines"),
                           F.when(F.col("__common").isNotNull(), kept).otherwise(lines).alias("__kept"))
    whole = ~F.exists("__kept", lambda x: F.trim(x) != "")
    staged = staged.withColumn("__kept", F.when(whole, F.col("__lines")).otherwise(F.col("__kept")))
    count = F.coalesce(F.size("__lines"), F.lit(0)).cast("long")
    text = F.when(F.size("__kept") == F.size("__lines"), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    own = [c for c in docs.columns if c not in ("lines", "lines_dropped")]
    return staged.select(*[text.alias(c) if c == text_col else F.col(c) for c in own],
                         F.when(F.col(text_col).isNull(), 0).otherwise(count).cast("long").alias("lines"),
                         F.when(F.col(text_col).isNull(), 0).otherwise(
                             count - F.size("__kept")).cast("long").alias("lines_dropped"))
