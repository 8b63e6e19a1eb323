"""Structured Streaming jobs over landed feed files and update logs.

Each job keeps its checkpoint, state and output below ``home``, a folder that the caller
names. A job that is started again with the same ``home`` goes on where it stopped, so a lost
executor or driver costs a repeat of the current micro-batch only. Without a ``home`` a job
takes a new folder below the shared one and starts from nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import blocks, live
from tidewatch.operators.live import ORD, last_tries, normalise, readable, snapshot_status
from tidewatch.session import folders, fresh_path, materialise, remove, settings

SNAPSHOT_SECONDS = 2 * 86400


def landed(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int = 64) -> DataFrame:
    """Stream of landed Parquet files, in bounded micro-batches."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", pattern).parquet(path))


#: Landed files that a stream remembers between micro-batches.
CACHED = 10_000_000
#: What opening a document counts in bytes when documents are dealt to tasks, and the tasks that look up a batch's files.
OPENING, LISTING = 64 << 10, 64


def landed_documents(spark: SparkSession, path: str, files_per_batch: int | None = None, bytes_per_batch: int = 128 << 20) -> DataFrame:
    """Stream of landed documents: ``body``, the ``file`` it came in, when that landed, and the ``code`` of its folder.

    A file is one document, whatever its line breaks. ``code`` is what a folder ``code=...``
    above the file names, and empty without one. Each micro-batch takes a bounded number of bytes, or
    of files if ``files_per_batch`` is given: documents are small, and a batch costs as much as many of them.
    """
    most = ("maxBytesPerTrigger", bytes_per_batch) if files_per_batch is None else ("maxFilesPerTrigger", files_per_batch)
    # all that is known to have landed is remembered between batches: by default every other batch would get 10,000 files only
    texts = spark.readStream.option(*most).option("maxCachedFiles", CACHED).text(path, wholetext=True, recursiveFileLookup=True)
    file = F.col("_metadata.file_path")
    return texts.select(F.col("value").alias("body"), file.alias("file"), F.col("_metadata.file_modification_time").alias("landed_at"),
                        F.regexp_extract(file, "/code=([^/]+)/", 1).alias("code"))


PROVENANCE = ("file", "landed_at")
REJECTS = "file string, landed_at timestamp, characters long, reason string, body string"


def feed_readings(documents: DataFrame, source: str, label: str, now, home: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Readings of a feed's landed documents with the file each came in, and the documents that could not be read.

    A broken document costs no more than itself: it goes to the rejects whole, with a reason. A
    micro-batch overwrites what it wrote before it was repeated, and a later run with the same ``home``
    only takes files that landed since. A task reads many documents, and each document once.
    """
    spark = documents.sparkSession
    home = home or fresh_path(spark, label)

    def step(batch: DataFrame, number: int) -> None:
        judged = batch.withColumn("_good", readable(source)).persist()
        rows = normalise(source, judged.filter("_good"), now, PROVENANCE)
        rows.write.mode("overwrite").parquet(f"{home}/out/batch={number}")
        reason = F.when(~F.col("body").rlike(r"\S"), "empty").otherwise(f"not a {source} document")
        judged.filter("NOT _good").select(*PROVENANCE, F.length("body").cast("long").alias("characters"), reason.alias("reason"),
                                          "body").write.mode("overwrite").parquet(f"{home}/rejects/batch={number}")
        judged.unpersist()

    with settings(spark, spark__sql__files__openCostInBytes=OPENING, spark__sql__sources__parallelPartitionDiscovery__parallelism=LISTING):
        query = (documents.writeStream.foreachBatch(step).option("checkpointLocation", f"{home}/state")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    shape = normalise(source, spark.createDataFrame([], "body string, file string, landed_at timestamp, code string"), now, PROVENANCE)
    if not folders(spark, f"{home}/out"):  # nothing has landed yet
        return shape, spark.createDataFrame([], REJECTS)
    read = lambda schema, name: spark.read.schema(schema).parquet(f"{home}/{name}")
    return read(shape.schema, "out"), read(REJECTS, "rejects")


def run_available(stream: DataFrame, label: str, mode: str = "append", home: str | None = None) -> DataFrame:
    """Run over what has landed, and return what was written, in this run and before."""
    spark = stream.sparkSession
    home = home or fresh_path(spark, label)
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{home}/out")
             .option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def daily_counts(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("event_type",), late: str = "1 day") -> DataFrame:
    """Events per day and key; a day is given out once the watermark has passed it."""
    windowed = events.withWatermark(time, late).groupBy(F.window(time, "1 day"), *keys).agg(F.count("*").alias("n"))
    return windowed.select(F.to_date("window.start").alias("day"), *keys, "n")


def distinct_readings(readings: DataFrame, time: str = "updated", late: str = "2 days") -> DataFrame:
    """Repeats of a reading dropped while the watermark still remembers it."""
    return readings.withWatermark(time, late).dropDuplicatesWithinWatermark(["source", "source_id"])


def late_rows(batch: DataFrame, closed_until: str, time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows on time, and rows for days that were already given out, for a side table."""
    edge = F.lit(closed_until).cast("timestamp")
    return batch.filter(F.col(time) >= edge), batch.filter(F.col(time) < edge)


def latest_groups(groups: DataFrame, label: str, keys: list[str], home: str | None = None) -> DataFrame:
    """The current row of each group of a streaming aggregate over what has landed.

    Groups are kept in the state store. A micro-batch writes only the groups it changed, as a
    table of its own that a repeat overwrites; the last one of each group is its current row.
    Before a run, tables of earlier runs are folded into one if there are more than ``FOLDED``.
    """
    spark = groups.sparkSession
    home = home or fresh_path(spark, label)
    _fold(spark, groups.schema, home, keys)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    query = (groups.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{home}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return _current(spark, groups.schema, home, keys, _logs(spark, home)).select(*groups.columns)


#: Tables of changes that a job may leave behind before they are folded into one.
FOLDED = 32


def _logs(spark: SparkSession, home: str) -> list[str]:
    """The tables that hold the current rows: the newest folded one that was written whole, and the batches after it."""
    whole = [name for name in folders(spark, f"{home}/out")
             if name.startswith("folded=") and "_SUCCESS" in folders(spark, f"{home}/out/{name}")]
    newest = max(whole, key=lambda name: int(name.split("=")[1]), default=None)
    upto = int(newest.split("=")[1]) if newest else -1
    later = [name for name in folders(spark, f"{home}/out") if name.startswith("batch=") and int(name.split("=")[1]) > upto]
    return ([newest] if newest else []) + later


def _current(spark: SparkSession, schema: T.StructType, home: str, keys: list[str], logs: list[str]) -> DataFrame:
    if not logs:
        return spark.createDataFrame([], schema)
    fields = [c for c in schema.names if c not in keys]
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:batch|folded)=(\d+)/", 1).cast("long")
    changes = spark.read.schema(schema).parquet(*[f"{home}/out/{name}" for name in logs]).withColumn("_number", number)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*fields), "_number").alias("_last")).select(*keys, "_last.*")


def _fold(spark: SparkSession, schema: T.StructType, home: str, keys: list[str]) -> None:
    """Write the current rows as one table and delete those it stands for; a fold that was cut short is done anew."""
    logs = _logs(spark, home)
    if len(logs) <= FOLDED:
        return
    upto = max(int(name.split("=")[1]) for name in logs)
    current = _current(spark, schema, home, keys, logs).select(*schema.names)
    current.write.mode("overwrite").parquet(f"{home}/out/folded={upto}")
    for name in logs:
        remove(spark, f"{home}/out/{name}")


def keep_latest(stream: DataFrame, label: str, keys: list[str], order: list[str],
                counted: dict[str, str] | None = None, home: str | None = None) -> DataFrame:
    """Latest row of each key over all micro-batches; ``counted`` maps a column to the SQL condition it counts."""
    counted = counted or {}
    fields = [c for c in stream.columns if c not in keys]
    groups = stream.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_row"),
                                       *[F.count_if(F.expr(c)).alias(n) for n, c in counted.items()])
    return latest_groups(groups, label, keys, home).select(*keys, "_row.*", *counted)


def source_health(attempts: DataFrame, label: str, now, keep_seconds: int = SNAPSHOT_SECONDS, home: str | None = None) -> DataFrame:
    """Status of each source from the log of its fetches, with how often it was tried.

    Only the last success and the last try of a source are state, so a busy source takes no
    more room than a quiet one.
    """
    return snapshot_status(latest_groups(last_tries(attempts), label, ["source"], home), now, keep_seconds)


def merged_leaders(readings: DataFrame, home: str, order: tuple[str, ...] = ("updated", "seq")) -> DataFrame:
    """The latest row of each reading with its leader, kept up by micro-batches that merge again only what they touch.

    A batch's readings touch the blocks that share a key or lie beside one of their cells, at any
    time. Those blocks are taken whole, blocked anew with the batch and merged; all others stay as
    they are. A batch writes the rows of what it merged, and a repeat overwrites them.
    """
    spark = readings.sparkSession
    fields = readings.columns
    kept = T.StructType([*readings.schema.fields, *T._parse_datatype_string("eid string, ord " + ORD + ", leader string, block string").fields])

    def step(batch: DataFrame, number: int) -> None:
        eid = F.concat_ws(":", "type", "source", "source_id")
        logs = [name for name in _logs(spark, home) if name != f"batch={number}"]
        before = materialise(_current(spark, kept, home, ["eid"], logs).select(*kept.names), "merge-before")
        latest = batch.withColumn("eid", eid).groupBy("eid").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("r"))
        latest = latest.select("eid", "r.*")
        known = before.select("eid", *[F.col(c).alias(f"_{c}") for c in order])
        newer = F.struct(*order) >= F.struct(*[f"_{c}" for c in order])
        fresh = materialise(latest.join(known, "eid", "left").filter(F.coalesce(newer, F.lit(True))).select("eid", *fields), "merge-fresh")
        keyed = before.select("block", "eid").join(live.matching_columns(before.select(*fields)).select("eid", F.explode("keys").alias("key")), "eid")
        reached = live.matching_columns(fresh.select(*fields)).select(F.explode("keys").alias("key"))
        reached = live.around(reached.select(live.timeless(F.col("key")).alias("place")).distinct(), "place").distinct()
        touched = (keyed.withColumn("place", live.timeless(F.col("key"))).join(reached, "place").select("block")
                   .unionByName(before.join(fresh.select("eid"), "eid", "left_semi").select("block")).distinct())
        again = before.join(touched, "block", "left_semi").join(fresh.select("eid"), "eid", "left_anti").select(*fields)
        rows = materialise(again.unionByName(fresh.select(*fields)), "merge-rows")
        merged = blocks.leaders_by_block(rows)
        (rows.withColumn("eid", eid).join(merged, "eid").select(*kept.names)
         .write.mode("overwrite").parquet(f"{home}/out/batch={number}"))

    _fold(spark, kept, home, ["eid"])
    query = (readings.writeStream.foreachBatch(step).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return _current(spark, kept, home, ["eid"], _logs(spark, home))


def merged_events(readings: DataFrame, label: str, home: str | None = None) -> DataFrame:
    """Live events out of a stream of readings: the latest reading of each id, merged and rated."""
    home = home or fresh_path(readings.sparkSession, label)
    current = materialise(merged_leaders(readings, home), "merged")
    return live.finalise(live.merge_readings(current.select(*readings.columns), current.select("eid", "leader", "ord")))
