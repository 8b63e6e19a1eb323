"""Tables written in the formats of the sources and read back by their readers, and the files that exports leave."""

from pyspark.sql import functions as F

from tidewatch.catalog import live as live_catalog
from tidewatch.catalog import query
from tidewatch.catalog.events import EXPORT_NAMES
from tidewatch.catalog.impact import rounded
from tidewatch.operators import events, live, spatial
from tidewatch.session import fresh_path
from tidewatch.sources import readers, sinks


def written(df, label, **options):
    """``df`` as CSV with a header in a new folder."""
    path = fresh_path(df.sparkSession, label)
    df.write.options(header=True, quote='"', escape='"', **options).csv(path)
    return path


@query("file_quake_pages", """SELECT id, CAST(event_date AS STRING) AS date, latitude, magnitude, coalesce(place, '') AS place FROM {quakes}""")
def file_quake_pages(t):
    """The catalogue in two pages of CSV that repeat events, read together and cleaned."""
    rows = t.quake_pages.select(
        F.col("event_date").cast("timestamp").alias("time"), "latitude", "longitude", F.col("depth_km").alias("depth"),
        F.col("magnitude").alias("mag"), F.lit("mb").alias("magType"), "place", "type", "id")
    pages = [written(rows.filter(F.year("time") < 1998), "page"), written(rows.filter(F.year("time") >= 1998), "page")]
    out = events.clean_quakes(readers.read_quake_pages(t.spark, pages).drop("time", "mag_type"), 2001)
    return out.select("id", F.col("event_date").cast("string").alias("date"), "latitude", "magnitude", "place")


@query("file_tracks", """SELECT sid, name, season, basin, track_type, CAST(epoch(iso_time) AS BIGINT) AS point_seq, lat, lon, usa_wind, wmo_wind
FROM {track_points} WHERE iso_time IS NOT NULL""")
def file_tracks(t):
    """Track points as text with a line of units among them."""
    names = {"SID": "sid", "SEASON": "season", "BASIN": "basin", "NAME": "name", "ISO_TIME": "iso_time", "LAT": "lat", "LON": "lon",
             "WMO_WIND": "wmo_wind", "WMO_PRES": "wmo_pres", "USA_WIND": "usa_wind", "USA_PRES": "usa_pres", "DIST2LAND": "dist2land",
             "TRACK_TYPE": "track_type"}
    rows = t.track_points.withColumn("iso_time", F.date_format("iso_time", "yyyy-MM-dd HH:mm:ss"))
    text = rows.select(*[F.coalesce(F.col(names[c]).cast("string"), F.lit(" ")).alias(c) if c in names else F.lit("TS").alias(c)
                         for c in readers.TRACK_COLUMNS])
    units = t.spark.createDataFrame([tuple("Year" if c == "SEASON" else "" for c in readers.TRACK_COLUMNS)], text.schema)
    out = readers.read_tracks(t.spark, written(text.unionByName(units), "tracks"))
    return out.select("sid", "name", "season", "basin", "track_type", "point_seq", "lat", "lon", "usa_wind", "wmo_wind")


@query("file_rates", "SELECT year, inr_per_usd FROM {fx}")
def file_rates(t):
    """Rates as one ``[meta, rows]`` document, a year without a value among them."""
    year = F.struct(F.col("year").cast("string").alias("date"), F.col("inr_per_usd").alias("value"))
    gap = F.struct(F.lit("1949").alias("date"), F.lit(None).cast("double").alias("value"))
    rows = t.fx.agg(F.concat(F.collect_list(year), F.array(gap)).alias("rows"))
    body = rows.select(F.concat(F.lit('[{"pages": 1}, '), F.to_json("rows", {"ignoreNullFields": "false"}), F.lit("]")))
    path = fresh_path(t.spark, "rates")
    body.write.text(path)
    return readers.read_rates(t.spark, path)


@query("file_features", """SELECT region, ring, count(*) AS points, round(min(lon), 6) AS west, round(max(lat), 6) AS north FROM (
  SELECT region, ring, lon, lat FROM {region_vertices}
  UNION ALL SELECT region, 1, (lon + west + 1) / 2, (lat + south + 1) / 2 FROM {region_vertices} JOIN {region_boxes} USING (region) WHERE south < 20) q
GROUP BY region, ring""")
def file_features(t):
    """Boxes as a GeoJSON collection, with holes in the southern ones."""
    boxes = t.region_boxes.select("region", "west", "south")
    hole = t.region_vertices.join(boxes, "region").filter("south < 20").select(
        "region", F.lit(1).cast("long").alias("ring"), "idx", ((F.col("lon") + F.col("west") + 1) / 2).alias("lon"),
        ((F.col("lat") + F.col("south") + 1) / 2).alias("lat"))
    rings = t.region_vertices.select("region", "ring", "idx", "lon", "lat").unionByName(hole).groupBy("region", "ring").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", F.array("lon", "lat").alias("p")))), lambda x: x["p"]).alias("r"))
    shapes = rings.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "r"))), lambda x: x["r"]).alias("rings"))
    feature = F.struct(F.struct(F.col("region").alias("shapeName")).alias("properties"),
                       F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry"))
    path = fresh_path(t.spark, "features")
    shapes.agg(F.to_json(F.struct(F.collect_list(feature).alias("features")))).write.text(path)
    out = spatial.geojson_vertices(readers.read_features(t.spark, path, "shapeName"), "shapeName")
    return rounded(out.groupBy("region", "ring").agg(F.count("*").alias("points"), F.min("lon").alias("west"), F.max("lat").alias("north")))


@query("file_latin", "SELECT c_custkey AS id, 'Bézier ' || c_name || ' ½' AS name FROM {customer}")
def file_latin(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Bézier "), "c_name", F.lit(" ½")).alias("name"))
    return readers.read_csv(t.spark, written(rows, "latin", encoding="ISO-8859-1"), "id long, name string", "ISO-8859-1")


@query("file_gzip", "SELECT s_suppkey, s_acctbal, s_name || ', \"quoted\"' AS name FROM {supplier}")
def file_gzip(t):
    rows = t.supplier.select("s_suppkey", F.lit("unread").alias("other"), "s_acctbal", F.concat("s_name", F.lit(', "quoted"')).alias("name"))
    path = written(rows, "gzip", compression="gzip")
    return readers.read_csv(t.spark, path, "s_suppkey long, other string, s_acctbal double, name string", columns=["s_suppkey", "s_acctbal", "name"])


@query("file_export", """WITH x AS (SELECT try_cast(start_year || '-' || lpad(start_month, 2, '0') || '-' || lpad(start_day, 2, '0') AS DATE) AS d, start_month AS m
  FROM {event_export} WHERE disaster_type = 'Flood')
SELECT count(*) AS records, count(*) - count(m) AS dropped_monthly, count(*) - count(d) AS dropped_daily FROM x""")
def file_export(t):
    path = written(t.event_export.withColumnsRenamed(EXPORT_NAMES), "export")
    return events.export_drops(readers.read_export(t.spark, path, events.EXPORT_COLUMNS), "flood")


@query("file_store", """SELECT r_name AS name, r_regionkey % 2 = 0 AS even, (SELECT count(*) FROM {nation} n WHERE n.n_regionkey = r.r_regionkey) AS nations
FROM {region} r""")
def file_store(t):
    """A store of two tables whose flags were written as text."""
    root = fresh_path(t.spark, "store")
    flag = F.when(F.col("r_regionkey") % 4 == 0, "TRUE").when(F.col("r_regionkey") % 2 == 0, "1").otherwise("no")
    sinks.write_store(t.region.withColumn("even", flag), f"{root}/region")
    sinks.write_store(t.nation, f"{root}/nation")
    tables = readers.load_tables(t.spark, root, ["region", "nation"], {"region": ["even"]})
    counts = tables["nation"].groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nations"))
    return tables["region"].join(counts, "r_regionkey", "left").select(F.col("r_name").alias("name"), "even", F.coalesce("nations", F.lit(0)).alias("nations"))


@query("file_snapshots", "SELECT source_id, latitude, at_s FROM {live_readings} WHERE source = 'usgs'")
def file_snapshots(t):
    path = fresh_path(t.spark, "snapshots")
    live_catalog.feed(t, "usgs").select("body").write.option("maxRecordsPerFile", 1).text(path)
    out = live.normalise_usgs(readers.read_documents(t.spark, path))
    return out.select("source_id", "latitude", F.unix_seconds("date").alias("at_s"))


@query("file_aliases", "SELECT source, name, geo_state, geo_name FROM {aliases}")
def file_aliases(t):
    return readers.read_aliases(t.spark, written(t.aliases, "aliases"))


@query("file_rejects", """SELECT kind, name, count(*) AS n FROM (SELECT 'late' AS kind, name, NULL AS events FROM {listed_names} WHERE event % 5 = 0
  UNION ALL SELECT 'odd', name, 3 FROM {listed_names} WHERE event % 7 = 0) q GROUP BY kind, name""")
def file_rejects(t):
    """Rejects of two kinds with different columns in one report."""
    parts = [t.listed_names.filter("event % 5 = 0").select(F.lit("late").alias("kind"), "name"),
             t.listed_names.filter("event % 7 = 0").select(F.lit("odd").alias("kind"), "name", F.lit(3).alias("events"))]
    path = fresh_path(t.spark, "rejects")
    sinks.write_rejects(parts, path)
    rows = readers.read_csv(t.spark, path, "kind string, name string, events long")
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


@query("file_metadata", """SELECT '{"quakes":{"rows":' || (SELECT count(*) FROM {quakes}) || ',"first_year":' || (SELECT min(year) FROM {quakes})
  || ',"last_year":' || (SELECT max(year) FROM {quakes}) || '},"regions":{"rows":' || (SELECT count(*) FROM {region_boxes}) || '}}' AS meta""")
def file_metadata(t):
    return sinks.metadata_json(sinks.build_metadata({"quakes": t.quakes, "regions": t.region_boxes}))


@query("file_digits", """SELECT p_partkey AS id, CAST(printf('%.6g', p_partkey * 1000.0 / 7) AS DOUBLE) AS large, CAST(printf('%.6g', 1.0 / (p_partkey + 2)) AS DOUBLE) AS small
FROM {part}""")
def file_digits(t):
    """Doubles to six significant digits through a CSV export."""
    rows = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 1000.0 / 7).alias("large"),
                         (1.0 / (F.col("p_partkey") + 2)).alias("small"), F.lit("left out").alias("other"))
    path = fresh_path(t.spark, "digits")
    sinks.write_csv(rows, path, ["id", "large", "small"])
    return readers.read_csv(t.spark, path, "id long, large double, small double")
