"""Live feed queries."""

from pyspark.sql import functions as F

from tidewatch.catalog import query
from tidewatch.functions.geo import lon_within
from tidewatch.operators import blocks
from tidewatch.operators import live as op
from tidewatch.operators.ranking import positions

NOW = 1704067200 + 30 * 86400


def now_ts():
    return F.timestamp_seconds(F.lit(NOW))


def readings(t):
    """The test readings in the shape that the normalisers produce."""
    magnitude = F.col("mag_tenths") / 10
    label = F.when(F.col("type") == "earthquake", F.format_string("M%.1f", magnitude)).when(
        F.col("alert").isNotNull(), F.concat(F.initcap("alert"), F.lit(" alert")))
    return t.live_readings.withColumns({
        "date": F.timestamp_seconds("at_s"), "updated": F.timestamp_seconds("updated_at"),
        "magnitude": magnitude.cast("double"), "severity_label": label, "url": F.lit(None).cast("string"),
        "wind_kmh": F.col("wind_kmh").cast("long")}).drop("at_s", "updated_at", "mag_tenths")


def feed(t, source):
    """The readings of one source written as that source's JSON, a few dozen to a document."""
    rows = t.live_readings.filter(F.col("source") == source)
    iso = F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    place = F.struct(F.array("longitude", "latitude").alias("coordinates"))
    if source == "usgs":
        feature = F.struct(F.col("source_id").alias("id"), place.alias("geometry"), F.struct(
            (F.col("mag_tenths") / 10).alias("mag"), F.col("location").alias("place"), (F.col("at_s") * 1000).alias("time"),
            F.col("title"), F.when(F.col("seq") % 2 == 0, "green").alias("alert")).alias("properties"))
        name = "features"
    elif source == "gdacs":
        code = F.when(F.col("type") == "earthquake", "EQ").when(F.col("type") == "cyclone", "TC").otherwise("FL")
        rows = rows.withColumn("code", code)
        feature = F.struct(place.alias("geometry"), F.struct(
            F.col("source_id").alias("eventid"), F.concat(F.lit("  "), F.col("title"), F.lit(" , ")).alias("name"),
            F.col("location").alias("country"), iso.alias("fromdate"), (F.col("seq") % 3 != 0).cast("string").alias("iscurrent"),
            F.initcap("alert").alias("alertlevel"), F.struct(
                F.coalesce(F.col("mag_tenths") / 10, F.col("wind_kmh").cast("double")).alias("severity"),
                F.lit("km/h").alias("severityunit")).alias("severitydata"), F.col("storm_name").alias("eventname"))
            .alias("properties"))
        name = "features"
    else:
        point = F.when(F.col("latitude").isNotNull(), F.struct(
            iso.alias("date"), F.lit("Point").alias("type"), F.to_json(F.array("longitude", "latitude")).alias("coordinates"),
            F.col("wind_kmh").cast("double").alias("magnitudeValue"), F.lit("kts").alias("magnitudeUnit"))).otherwise(
            F.struct(iso.alias("date"), F.lit("Polygon").alias("type"), F.lit("[[[1,2],[3,4],[1,2]]]").alias("coordinates"),
                     F.col("wind_kmh").cast("double").alias("magnitudeValue"), F.lit("kts").alias("magnitudeUnit")))
        category = F.when(F.col("type") == "cyclone", "severeStorms").when(F.col("seq") % 10 == 5, "wildfires").otherwise("floods")
        links = F.when(F.col("gdacs_event_id").isNotNull() & (F.col("seq") % 4 != 0), F.array(F.struct(
            F.lit("GDACS").alias("id"), F.concat(F.lit("http://x/?eventid="), "gdacs_event_id").alias("url")))).otherwise(
            F.array().cast("array<struct<id:string,url:string>>"))
        closed = F.when(F.col("seq") % 11 == 3, F.lit("2024-01-02T00:00:00Z"))
        feature = F.struct(F.col("source_id").alias("id"), F.col("title"), closed.alias("closed"),
                           F.array(F.struct(category.alias("id"))).alias("categories"), links.alias("sources"),
                           F.array(point, point).alias("geometry"))
        name = "events"
    keys = [(F.col("seq") / 90).cast("long").alias("page")] + ([F.col("code")] if source == "gdacs" else [])
    return rows.groupBy(*keys).agg(F.to_json(F.struct(F.collect_list(feature).alias(name))).alias("body"))


@query("normalise_usgs", """SELECT source_id, title, latitude, longitude, at_s, location, CASE WHEN seq % 2 = 0 THEN 'green' END AS alert,
  'M' || printf('%.1f', mag_tenths / 10) || CASE WHEN seq % 2 = 0 THEN ' · PAGER green' ELSE '' END AS severity_label
FROM {live_readings} WHERE source = 'usgs'""")
def normalise_usgs(t):
    return op.normalise_usgs(feed(t, "usgs")).select(
        "source_id", "title", "latitude", "longitude", F.unix_seconds("date").alias("at_s"), "location", "alert", "severity_label")


@query("normalise_gdacs", f"""SELECT CASE type WHEN 'earthquake' THEN 'EQ' WHEN 'cyclone' THEN 'TC' ELSE 'FL' END || source_id AS source_id,
  type, title, latitude, longitude, at_s, alert, CAST(CASE WHEN type = 'cyclone' THEN wind_kmh END AS BIGINT) AS wind_kmh,
  storm_name FROM {{live_readings}} WHERE source = 'gdacs' AND CASE WHEN type = 'earthquake' THEN at_s >= {NOW} - 7 * 86400
  ELSE seq % 3 <> 0 END""")
def normalise_gdacs(t):
    return op.normalise_gdacs(feed(t, "gdacs"), now_ts()).select(
        "source_id", "type", "title", "latitude", "longitude", F.unix_seconds("date").alias("at_s"), "alert", "wind_kmh", "storm_name")


@query("normalise_eonet", """SELECT source_id, type, latitude, longitude, at_s, CASE WHEN seq % 4 <> 0 THEN gdacs_event_id END AS gdacs_event_id,
  CAST(CASE WHEN type = 'cyclone' THEN round_even(wind_kmh * 1.852, 0) END AS BIGINT) AS wind_kmh,
  CASE WHEN type = 'cyclone' THEN 2 END AS track_points
FROM {live_readings} WHERE source = 'eonet' AND seq % 11 <> 3 AND (type = 'cyclone' OR seq % 10 <> 5)
  AND (latitude IS NOT NULL OR (gdacs_event_id IS NOT NULL AND seq % 4 <> 0))""")
def normalise_eonet(t):
    out = op.normalise_eonet(feed(t, "eonet"), now_ts())
    return out.select("source_id", "type", "latitude", "longitude", F.unix_seconds("date").alias("at_s"), "gdacs_event_id",
                      "wind_kmh", F.when(F.col("track").isNotNull(), F.size("track.observed")).alias("track_points"))


@query("unlocatable", """SELECT count(*) AS unlocatable_skipped FROM {live_readings} WHERE source = 'eonet' AND seq % 11 <> 3
  AND (type = 'cyclone' OR seq % 10 <> 5) AND latitude IS NULL AND (gdacs_event_id IS NULL OR seq % 4 = 0)""")
def unlocatable(t):
    return op.unlocatable(feed(t, "eonet"), now_ts())


@query("storm_keys", """SELECT title, lower(regexp_extract(title, '(NAME[0-9]+X)', 1)) AS key, count(*) AS n FROM {live_readings}
WHERE type = 'cyclone' GROUP BY title""")
def storm_keys(t):
    from tidewatch.functions.text import storm_key

    return t.live_readings.filter("type = 'cyclone'").groupBy("title").agg(F.count("*").alias("n")).withColumn(
        "key", storm_key(F.col("title")))


@query("merge_readings")
def merge_readings(t):
    events = op.finalise(op.merge_readings(readings(t)))
    return events.select("id", "type", "alert", "severity_level", "readings", "n_sources", "disagreement", "labels")


@query("merge_by_block", """SELECT count(*) AS readings, count(DISTINCT type || source || source_id) AS merged, true AS as_in_rounds FROM {live_readings}""")
def merge_by_block(t):
    """Every reading has one leader, the same by blocks as by rounds over all readings."""
    rows = readings(t)
    found = blocks.leaders_by_block(rows)
    rounds = op.assign_leaders(rows).select("eid", F.col("leader").alias("other"))
    return found.join(rounds, "eid", "full").agg(F.count("*").alias("readings"), F.count("leader").alias("merged"),
                                                 F.bool_and(F.col("leader").eqNullSafe(F.col("other"))).alias("as_in_rounds"))


@query("current_readings", f"""SELECT source_id, type FROM {{live_readings}}
WHERE at_s <= {NOW} AND at_s >= CASE WHEN type = 'earthquake' THEN {NOW} - 7 * 86400 ELSE {NOW} - 30 * 86400 END""")
def current_readings(t):
    return op.current_readings(readings(t), now_ts()).select("source_id", "type")


def as_events(t):
    """Each reading as an event of its own, for the operators behind the merge."""
    rows = readings(t)
    gdacs = F.when((F.col("source") == "gdacs"), F.col("alert"))
    usgs = F.when(F.col("source") == "usgs", F.col("magnitude"))
    return op.finalise(rows.withColumns({"id": F.col("source_id"), "gdacs_alert": gdacs, "usgs_magnitude": usgs}))


SEVERITY_SQL = """ev AS (SELECT *, mag_tenths / 10 AS magnitude, CASE WHEN source = 'gdacs' THEN CASE alert WHEN 'green' THEN 'moderate'
    WHEN 'orange' THEN 'high' WHEN 'red' THEN 'very_high' END WHEN source = 'usgs' THEN CASE WHEN mag_tenths >= 70 THEN 'very_high'
    WHEN mag_tenths >= 60 THEN 'high' WHEN mag_tenths >= 45 THEN 'moderate' END END AS severity_level,
  CASE WHEN type = 'earthquake' THEN at_s ELSE coalesce(updated_at, at_s) END AS time FROM {live_readings})"""


@query("severity_levels", f"""WITH {SEVERITY_SQL} SELECT source_id AS id, severity_level, CASE WHEN source = 'gdacs' AND alert IS NOT NULL
  THEN 'GDACS ' || upper(alert[1]) || substr(alert, 2) || ' alert' WHEN source = 'usgs' AND mag_tenths >= 45
  THEN 'USGS M' || printf('%.1f', magnitude) || ', no GDACS alert' END AS severity_basis,
  coalesce(location, title) AS place, time FROM ev""")
def severity_levels(t):
    return as_events(t).select("id", "severity_level", "severity_basis", "place", F.unix_seconds("time").alias("time"))


@query("location_counts", """SELECT type, count(latitude) AS count, count(*) - count(latitude) AS unlocated FROM {live_readings} GROUP BY type""")
def location_counts(t):
    return op.location_counts(readings(t))


@query("located_events", "SELECT source_id FROM {live_readings} WHERE latitude IS NOT NULL")
def located_events(t):
    return op.located(as_events(t)).select("source_id")


STATUS_SQL = f"""g AS (SELECT source, max_by(at_s, (at_s, event_id)) AS at_s, max_by(events, (at_s, event_id)) AS events FROM {{attempts}} WHERE ok GROUP BY source),
l AS (SELECT source, max(at_s) AS tried_at, max_by(ok, (at_s, event_id)) AS ok, max_by(error, (at_s, event_id)) AS error FROM {{attempts}} GROUP BY source),
snap AS (SELECT l.source, CASE WHEN l.ok THEN 'ok' WHEN g.at_s IS NOT NULL AND {NOW} - g.at_s <= 172800 * 20 THEN 'stale' ELSE 'unavailable' END
  AS status, g.at_s, g.events, CASE WHEN NOT l.ok THEN l.error END AS error, l.tried_at FROM l LEFT JOIN g USING (source))"""


def snapshots(t):
    return op.last_good(t.attempts.withColumnRenamed("at_s", "at"), F.lit(NOW), 172800 * 20)


@query("last_good", f"""WITH {STATUS_SQL} SELECT source, status, CASE WHEN status <> 'unavailable' THEN at_s END AS "at",
  CAST(CASE WHEN status <> 'unavailable' THEN events ELSE 0 END AS BIGINT) AS count, error, tried_at FROM snap""")
def last_good(t):
    return snapshots(t)


@query("source_status", f"""WITH {STATUS_SQL} SELECT source, {NOW} - CASE WHEN status <> 'unavailable' THEN at_s END AS age_seconds,
  CASE WHEN status = 'ok' THEN {NOW} - at_s > 600 ELSE {NOW} - tried_at > 60 END AS due FROM snap""")
def source_status(t):
    return op.source_status(snapshots(t), F.lit(NOW)).select("source", "age_seconds", "due")


@query("layer_status", f"""WITH {STATUS_SQL}, ls(type, source) AS (VALUES ('earthquake', 'usgs'), ('earthquake', 'gdacs'), ('flood', 'gdacs'),
  ('flood', 'eonet'), ('cyclone', 'gdacs'), ('cyclone', 'eonet')),
c AS (SELECT type, count(latitude) AS count, count(*) - count(latitude) AS unlocated FROM {{live_readings}} GROUP BY type)
SELECT ls.type, CASE WHEN bool_and(coalesce(status IN ('ok', 'stale'), false)) THEN 'ok'
  WHEN bool_or(coalesce(status IN ('ok', 'stale'), false)) THEN 'partial' ELSE 'unavailable' END AS status,
  any_value(c.count) AS count, any_value(c.unlocated) AS unlocated
FROM ls LEFT JOIN snap USING (source) JOIN c ON c.type = ls.type GROUP BY ls.type""")
def layer_status(t):
    return op.layer_status(snapshots(t), op.location_counts(readings(t)))


@query("link_tracks", """WITH p AS (SELECT sid, lat, lon, iso_time, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM (
    SELECT sid, iso_time, min(lat) + epoch(iso_time) / 1e13 AS lat, min(lon) AS lon FROM {track_points} GROUP BY sid, iso_time) u
  WINDOW w AS (PARTITION BY sid ORDER BY iso_time))
SELECT sid AS storm, CAST(row_number() OVER (PARTITION BY sid ORDER BY iso_time) - 1 AS INT) AS place, round_even(lat, 3) AS lat,
  round_even(lon, 3) AS lon FROM p WHERE sid IN (SELECT sid FROM p GROUP BY sid HAVING count(*) >= 2)""")
def link_tracks(t):
    """Segments between consecutive positions, in no order."""
    from pyspark.sql import Window as W

    order = W.partitionBy("sid").orderBy("iso_time")
    points = t.track_points.groupBy("sid", "iso_time").agg(
        (F.min("lat") + F.unix_seconds(F.first("iso_time")) / 1e13).alias("lat"), F.min("lon").alias("lon"))
    segments = points.select(
        F.col("sid").alias("storm"), F.lit(False).alias("forecast"), F.hash("sid", "iso_time").alias("seq"),
        F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.lead("lon").over(order).alias("x2"),
        F.lead("lat").over(order).alias("y2")).filter("x2 IS NOT NULL")
    return op.link_tracks(segments).drop("forecast")


@query("filter_events", f"""WITH {SEVERITY_SQL} SELECT source_id FROM ev WHERE type IN ('earthquake', 'flood')
  AND coalesce(severity_level, 'unrated') IN ('high', 'unrated')""")
def filter_events(t):
    return op.filter_events(as_events(t), ["earthquake", "flood"], ["high", "unrated"]).select("source_id")


@query("events_by_magnitude", f"""WITH {SEVERITY_SQL}, sized AS (SELECT *, CASE WHEN type = 'earthquake' THEN magnitude END AS size FROM ev)
SELECT source_id, size, row_number() OVER (ORDER BY size DESC NULLS LAST, time DESC NULLS LAST, source_id) AS place FROM sized""")
def events_by_magnitude(t):
    """All events, largest quakes first, each with its place."""
    size = F.when(F.col("type") == "earthquake", F.col("magnitude"))
    return positions(op.sort_events(as_events(t), "magnitude").select("source_id", size.alias("size")))


@query("events_by_severity", f"""WITH {SEVERITY_SQL} SELECT source_id, severity_level, row_number() OVER (ORDER BY
  CASE severity_level WHEN 'very_high' THEN 3 WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END DESC, time DESC NULLS LAST, source_id) AS place FROM ev""")
def events_by_severity(t):
    return positions(op.sort_events(as_events(t), "severity").select("source_id", "severity_level"))


@query("events_by_recency", f"""WITH {SEVERITY_SQL} SELECT source_id, row_number() OVER (ORDER BY time DESC NULLS LAST, source_id) AS place FROM ev""")
def events_by_recency(t):
    return positions(op.sort_events(as_events(t)).select("source_id"))


@query("dominant_types", """SELECT cell, CASE mod(max(n * 10 - p) + 1000000, 10) WHEN 0 THEN 'earthquake' WHEN 9 THEN 'flood' ELSE 'cyclone' END AS type,
  CAST(sum(n) AS BIGINT) AS events FROM (SELECT CAST(floor(latitude / 20) AS BIGINT) AS cell, type, count(*) AS n,
    CASE type WHEN 'earthquake' THEN 0 WHEN 'flood' THEN 1 ELSE 2 END AS p FROM {live_readings} WHERE latitude IS NOT NULL GROUP BY ALL) q
GROUP BY cell""")
def dominant_types(t):
    rows = readings(t).filter("latitude IS NOT NULL").withColumn("cell", F.floor(F.col("latitude") / 20))
    return op.dominant_type(rows, ["cell"])


@query("search_rows", """SELECT doc_id FROM {documents} WHERE contains(lower(concat_ws(' ', text, lang, source)), 'the')""")
def search_rows(t):
    return op.search_rows(t.documents, "The", ["text", "lang", "source"]).select("doc_id")


@query("sort_column", """SELECT source_id, latitude, row_number() OVER (ORDER BY latitude DESC NULLS FIRST, source_id NULLS LAST) AS place
FROM {live_readings}""")
def sort_column(t):
    rows = t.live_readings.select("latitude", "source_id")
    return positions(op.sort_column(rows, "latitude", descending=True))


@query("preview_rows", """SELECT source_id, longitude FROM {live_readings} ORDER BY longitude NULLS LAST, source_id LIMIT 50""")
def preview_rows(t):
    return op.sort_column(t.live_readings.select("longitude", "source_id"), "longitude").limit(50)


@query("map_bounds", """SELECT source_id FROM {live_readings} WHERE latitude BETWEEN -30 AND 30
AND (longitude BETWEEN 170 AND 200 OR longitude + 360 BETWEEN 170 AND 200 OR longitude - 360 BETWEEN 170 AND 200)""")
def map_bounds(t):
    inside = F.col("latitude").between(-30, 30) & lon_within(F.col("longitude"), F.lit(170), F.lit(200))
    return t.live_readings.filter(inside).select("source_id")
