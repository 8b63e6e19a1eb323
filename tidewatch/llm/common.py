"""Helpers that several operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import materialise, remove

__all__ = ["bytes_of", "crc_mod", "forget", "materialise", "registered", "row_key", "shuffle_width", "table", "word_runs"]

#: Queries of this package by name, and their reference SQL.
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(*tables: DataFrame) -> None:
    """Delete working tables of ``materialise`` that nothing reads any more, which is when all that came of them is written."""
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            remove(df.sparkSession, folder)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of a value's text, modulo ``modulus``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def row_key() -> Column:
    """A random 128-bit row name. Materialise it before it is used twice."""
    return F.expr("uuid()")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_of(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column's values, one by one."""
    for value in column.cast(pa.binary()):
        yield value.as_py()


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, in runs from about ``size`` bytes each.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space.
    """
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > size and (space := _SPACE.search(text, at + size)):
            stop = space.start()
        yield text[at:stop].lower().split()
        at = stop
