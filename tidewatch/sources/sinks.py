"""Writers: the table store, CSV exports and build metadata."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def six_digits(df: DataFrame) -> DataFrame:
    """Doubles as text with six significant digits, trailing zeros left out."""
    def short(name: str):
        value = F.col(name)
        exponent = F.floor(F.log10(F.abs(value)))
        small = (value == 0) | value.isNull()
        scale = F.pow(F.lit(10.0), F.lit(5) - exponent)
        rounded = F.when(small, value).otherwise(F.rint(value * scale) / scale)
        return F.regexp_replace(rounded.cast("string"), r"\.0$", "")

    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({name: short(name) for name in doubles})


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, digits: bool = True) -> None:
    """CSV with a header and quoted as the RFC asks; the partitions are written side by side."""
    out = df.select(*columns) if columns else df
    out = six_digits(out) if digits else out
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_store(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, one folder per type, so that a query for one type reads only its files.

    The rows are first brought together by the folder column. Adaptive execution splits a
    folder by its size, so one that holds a third of the rows is written by as many tasks as
    that takes, and small folders are not cut up.
    """
    if not by:
        df.write.mode("overwrite").parquet(path)
        return
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_documents(df: DataFrame, path: str, name: str, by: list[str] | None = None, body: str = "body") -> None:
    """Each row's text with a line end as a file of its own, named by the column ``name``, below folders of the columns ``by``.

    Names are meant to differ within a folder, and a repeated task then writes the same files once more. In a local or
    mounted folder the tasks make the files themselves, as Hadoop starts processes for each one; elsewhere Spark's writer
    makes and names them.
    """
    by = by or []
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        df.select(*by, body).write.partitionBy(*by).option("maxRecordsPerFile", 1).option(
            "mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
        return
    root = where.toUri().getPath()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                folder = os.path.join(root, *[f"{c}={quote(row[c] or '__HIVE_DEFAULT_PARTITION__', safe='')}" for c in by])
                os.makedirs(folder, exist_ok=True)
                file = os.path.join(folder, f"doc-{quote(str(row['_name']), safe='')}.txt")
                part = os.path.join(folder, f"_{os.path.basename(file)}-{os.urandom(8).hex()}")  # what begins so is not read
                with open(part, "w", encoding="utf-8", newline="") as out:
                    out.write(f"{row['_body'] or ''}\n")
                os.replace(part, file)
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    rows = df.select(*[F.col(c).cast("string").alias(c) for c in by], F.col(name).cast("string").alias("_name"), F.col(body).alias("_body"))
    os.makedirs(root, exist_ok=True)
    rows.mapInArrow(put, "files long").agg(F.sum("files")).collect()


def build_metadata(tables: dict[str, DataFrame], year: str = "year") -> DataFrame:
    """Rows and first and last year of each table, one line per table."""
    out = None
    for name, df in tables.items():
        span = (F.min(year), F.max(year)) if year in df.columns else (F.lit(None), F.lit(None))
        line = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), span[0].cast("long").alias("first_year"),
                      span[1].cast("long").alias("last_year"))
        out = line if out is None else out.unionByName(line)
    return out


def metadata_json(metadata: DataFrame) -> DataFrame:
    """The metadata as one JSON text; there is one line per table."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("table", F.struct("rows", "first_year", "last_year").alias("facts")))))
    return metadata.agg(F.to_json(entries).alias("meta"))


def write_rejects(parts: list[DataFrame], path: str) -> None:
    """The names that found no place, from all sources in one file."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    write_csv(out, path, digits=False)
