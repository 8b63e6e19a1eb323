"""Readers of the landed files. All of them are lazy and take an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUAKE_SCHEMA = ("time timestamp, latitude double, longitude double, depth double, mag double, magType string, "
                "place string, type string, id string")
TRACK_COLUMNS = ["SID", "SEASON", "BASIN", "NAME", "ISO_TIME", "NATURE", "LAT", "LON", "WMO_WIND", "WMO_PRES", "USA_WIND",
                 "USA_PRES", "DIST2LAND", "TRACK_TYPE"]
TRACK_NUMBERS = ["SEASON", "LAT", "LON", "WMO_WIND", "WMO_PRES", "USA_WIND", "USA_PRES", "DIST2LAND"]
ALIAS_SCHEMA = "source string, name string, geo_state string, geo_name string"


def read_csv(spark: SparkSession, path, schema: str, encoding: str = "UTF-8", columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, plain or gzip; columns are picked by name so that only they are parsed."""
    df = spark.read.schema(schema).option("header", True).option("encoding", encoding).option("escape", '"').csv(path)
    return df.select(*columns) if columns else df


def read_quake_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Catalogue pages in one table; empty pages simply have no rows."""
    rows = spark.read.schema(QUAKE_SCHEMA).option("header", True).csv(paths)
    return rows.select("id", "type", F.to_date("time").alias("event_date"), F.col("time"), "latitude", "longitude",
                       F.col("depth").alias("depth_km"), F.col("mag").alias("magnitude"),
                       F.col("magType").alias("mag_type"), "place")


def read_tracks(spark: SparkSession, path) -> DataFrame:
    """Track points from a file whose second line holds units; blanks are null, "NA" is a basin."""
    schema = ", ".join(f"{c} string" for c in TRACK_COLUMNS)
    raw = spark.read.schema(schema).option("header", True).option("nullValue", "").option("enforceSchema", False).csv(path)
    text = {c: F.nullif(F.trim(c), F.lit("")) for c in TRACK_COLUMNS}
    rows = raw.withColumns(text).withColumns({c: F.col(c).try_cast("double") for c in TRACK_NUMBERS})
    rows = rows.filter(F.col("SEASON").isNotNull())
    return rows.select(
        F.col("SID").alias("sid"), F.col("NAME").alias("name"), F.col("SEASON").cast("long").alias("season"),
        F.col("BASIN").alias("basin"), F.col("TRACK_TYPE").alias("track_type"),
        F.try_to_timestamp("ISO_TIME").alias("iso_time"), F.unix_seconds(F.try_to_timestamp("ISO_TIME")).alias("point_seq"),
        F.col("LAT").alias("lat"), F.col("LON").alias("lon"), F.col("USA_WIND").alias("usa_wind"),
        F.col("WMO_WIND").alias("wmo_wind"), F.col("USA_PRES").alias("usa_pres"), F.col("WMO_PRES").alias("wmo_pres"),
        F.col("DIST2LAND").alias("dist2land"))


def parse_rates(documents: DataFrame, body: str = "body") -> DataFrame:
    """Exchange rates from ``[meta, rows]`` documents; years without a value are dropped."""
    rows = F.from_json(F.get(F.from_json(body, "array<string>"), 1), "array<struct<date string, value double>>")
    return documents.select(F.explode(rows).alias("r")).filter("r.value IS NOT NULL").select(
        F.col("r.date").cast("long").alias("year"), F.col("r.value").alias("inr_per_usd"))


def read_rates(spark: SparkSession, path) -> DataFrame:
    """Rates from a JSON file; a file without any rate is an error."""
    rates = parse_rates(spark.read.text(path, wholetext=True), "value")
    if rates.isEmpty():
        raise ValueError("the document holds no exchange rates")
    return rates


def read_documents(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """Whole JSON files as ``body`` texts: weather series, boundaries and feed snapshots."""
    return spark.read.text(path, wholetext=multiline).withColumnRenamed("value", "body")


def read_features(spark: SparkSession, path, name: str) -> DataFrame:
    """GeoJSON features with their coordinates kept as text."""
    schema = (f"features array<struct<properties struct<{name} string>, geometry struct<type string, coordinates string>>>")
    return spark.read.schema(schema).option("multiLine", True).json(path).select(
        F.explode("features").alias("f")).select("f.*")


def read_export(spark: SparkSession, path, needed: list[str]) -> DataFrame:
    """The full event export as text columns, after a check that the needed ones are there."""
    df = spark.read.option("header", True).csv(path)
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"the event export lacks columns: {', '.join(missing)}")
    return df


def read_aliases(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(ALIAS_SCHEMA).option("header", True).csv(path).fillna("")


def text_flags(df: DataFrame, flags: list[str]) -> DataFrame:
    """Flags that were written as text, as booleans."""
    return df.withColumns({f: F.lower(F.col(f).cast("string")).isin("1", "true") for f in flags})


def load_tables(spark: SparkSession, root: str, names: list[str], flags: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """All tables of a store by name."""
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in names}
    return {name: text_flags(df, (flags or {}).get(name, [])) for name, df in tables.items()}
