"""Spatial queries over the region boxes."""

from pyspark.sql import functions as F

from tidewatch.catalog import query
from tidewatch.catalog.impact import rounded
from tidewatch.functions import geo
from tidewatch.operators import spatial as op


def km_sql(lat1, lon1, lat2, lon2, radius="6371.0088"):
    return (f"{radius} * 2 * asin(sqrt(least(1.0, power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1}))"
            f" * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))")


MARKS_SQL = """e AS (SELECT region, idx, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2
    FROM {region_vertices} WINDOW w AS (PARTITION BY region ORDER BY idx)),
n AS (SELECT *, CAST(greatest(ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 0.05), 1) AS BIGINT) AS n
    FROM e WHERE x2 IS NOT NULL),
marks AS (SELECT region, x1 + (x2 - x1) * k / n AS lon, y1 + (y2 - y1) * k / n AS lat
    FROM (SELECT *, unnest(range(n)) AS k FROM n) s)"""

QUAKE_SQL = f"""{MARKS_SQL},
cand AS (SELECT b.region, q.*, (longitude >= west AND longitude < east AND latitude >= south AND latitude < north) AS inside
    FROM {{quakes}} q JOIN {{region_boxes}} b ON latitude BETWEEN south - 4 AND north + 4
      AND longitude BETWEEN west - 6 AND east + 6),
dist AS (SELECT c.region, c.id, min({km_sql('c.latitude', 'c.longitude', 'm.lat', 'm.lon')}) AS d
    FROM cand c JOIN marks m ON m.region = c.region WHERE NOT inside GROUP BY c.region, c.id),
hit AS (SELECT c.*, CASE WHEN inside THEN 0 ELSE round_even(d, 0) END AS dist_km FROM cand c LEFT JOIN dist USING (region, id)
    WHERE inside OR d <= 300)"""

STORM_SQL = f"""{MARKS_SQL},
tr AS (SELECT *, coalesce(usa_wind, wmo_wind) AS wind_kt, CASE WHEN usa_wind IS NOT NULL THEN 'US agencies (1-min)'
      ELSE 'IMD (3-min)' END AS wind_source FROM {{track_points}} WHERE basin = 'NI' AND track_type = 'main'
      AND lat BETWEEN 0 AND 40 AND lon BETWEEN 55 AND 105 AND coalesce(usa_wind, wmo_wind) >= 34),
cand AS (SELECT b.region, t.*, row_number() OVER () AS pid,
      (lon >= west AND lon < east AND lat >= south AND lat < north) AS inside
    FROM tr t JOIN {{region_boxes}} b ON lat BETWEEN south - 2 AND north + 2 AND lon BETWEEN west - 3 AND east + 3),
dist AS (SELECT c.pid, min({km_sql('c.lat', 'c.lon', 'm.lat', 'm.lon')}) AS d
    FROM cand c JOIN marks m ON m.region = c.region WHERE NOT inside GROUP BY c.pid),
hit AS (SELECT c.*, CASE WHEN inside THEN 0 ELSE d END AS dist_km FROM cand c LEFT JOIN dist USING (pid)
    WHERE inside OR d <= 100),
per AS (SELECT region, sid, max(wind_kt) AS max_wind_kt, min(dist_km) AS min_dist_km, any_value(name) AS name,
    any_value(season) AS season FROM hit GROUP BY region, sid)"""


@query("haversine", f"""SELECT n_nationkey, round({km_sql('n_nationkey * 2.5', 'n_nationkey * 7', '10.0', '77.5')}, 6) AS km
FROM {{nation}}""")
def haversine(t):
    return t.nation.select("n_nationkey", F.round(geo.haversine_km(
        F.col("n_nationkey") * 2.5, F.col("n_nationkey") * 7, F.lit(10.0), F.lit(77.5)), 6).alias("km"))


@query("weather_cells", """SELECT district, round_even(round_even(lat / 0.5, 0) * 0.5, 3) AS cell_lat,
  round_even(round_even(lon / 0.625, 0) * 0.625, 3) AS cell_lon FROM {districts}""")
def weather_cells(t):
    lat, lon = geo.weather_cell(F.col("lat"), F.col("lon"))
    return t.districts.select("district", lat.alias("cell_lat"), lon.alias("cell_lon"))


@query("degree_cells", """SELECT CAST(floor(latitude / 5) AS BIGINT) || '_' || CAST(floor(longitude / 5) AS BIGINT) AS cell,
  count(*) AS quakes FROM {quakes} GROUP BY 1""")
def degree_cells(t):
    cell = geo.degree_cell(F.col("latitude"), F.col("longitude")).alias("cell")
    return t.quakes.groupBy(cell).agg(F.count("*").alias("quakes"))


@query("region_measures", """SELECT region, west, east, south, north, round((east - west) * (north - south), 6) AS area
FROM {region_boxes}""")
def region_measures(t):
    return rounded(op.areas(t.region_vertices))


@query("region_centroids", """SELECT region, round_even((south + north) / 2, 3) AS latitude,
  round_even((west + east) / 2, 3) AS longitude FROM {region_boxes}""")
def region_centroids(t):
    return op.centroids(t.region_vertices)


@query("geojson_vertices", """SELECT region, part, ring, idx, lon, lat FROM {region_vertices}""")
def geojson_vertices(t):
    """The boxes written as GeoJSON text and read back; every third one as a MultiPolygon."""
    ring = F.array_sort(F.collect_list(F.struct("idx", F.array("lon", "lat").alias("p"))))
    shapes = t.region_vertices.groupBy("region").agg(F.transform(ring, lambda x: x["p"]).alias("r"))
    multi = F.length("region") % 3 == 0
    features = shapes.select(
        F.struct(F.col("region").alias("shapeName")).alias("properties"),
        F.struct(F.when(multi, "MultiPolygon").otherwise("Polygon").alias("type"),
                 F.when(multi, F.to_json(F.array(F.array("r")))).otherwise(F.to_json(F.array("r"))).alias("coordinates"))
        .alias("geometry"))
    return op.geojson_vertices(features, "shapeName")


@query("containing_regions", """SELECT b.region, q.id FROM {quakes} q JOIN {region_boxes} b
ON longitude >= west AND longitude < east AND latitude >= south AND latitude < north""")
def containing_regions(t):
    return op.containing_regions(t.quakes.select("id", "latitude", "longitude"), t.region_vertices,
                                 "latitude", "longitude").select("region", "id")


@query("assign_regions", f"""WITH {MARKS_SQL}, inb AS (SELECT d.district, min(region) AS region FROM {{districts}} d
    JOIN {{region_boxes}} b ON lon >= west AND lon < east AND lat >= south AND lat < north GROUP BY d.district),
near AS (SELECT district, region FROM (SELECT d.district, m.region, row_number() OVER (PARTITION BY d.district
    ORDER BY min({km_sql('d.lat', 'd.lon', 'm.lat', 'm.lon')}), m.region) AS rn
  FROM {{districts}} d, marks m GROUP BY d.district, m.region) q WHERE rn = 1)
SELECT d.district, CASE WHEN d.district = 'D03' THEN 'Elsewhere' ELSE coalesce(inb.region, near.region) END AS region,
  CASE WHEN d.district = 'D03' THEN 'override' WHEN inb.region IS NOT NULL THEN 'inside' ELSE 'nearest' END AS how
FROM {{districts}} d LEFT JOIN inb USING (district) LEFT JOIN near USING (district)""")
def assign_regions(t):
    points = t.districts.select("district", "lat", "lon")
    return op.assign_regions(points, t.region_vertices, "district", {"D03": "Elsewhere"}).select(
        "district", "region", "how")


@query("labelled_regions", """SELECT p_partkey AS part, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1
  THEN p_name || ' (' || p_brand || ')' ELSE p_name END AS district FROM {part}""")
def labelled_regions(t):
    return op.label_regions(t.part, "p_name", "p_brand").select(F.col("p_partkey").alias("part"), "district")


@query("quake_exposure", f"WITH {QUAKE_SQL} SELECT region, id, magnitude, dist_km FROM hit")
def quake_exposure(t):
    return op.quake_exposure(t.quakes, t.region_vertices).select("region", "id", "magnitude", "dist_km")


@query("quake_metrics", f"""WITH {QUAKE_SQL}, best AS (SELECT * FROM (SELECT region, magnitude, year, place, row_number() OVER (
    PARTITION BY region ORDER BY magnitude DESC, year, coalesce(place, '') DESC, id DESC) AS rn FROM hit) q WHERE rn = 1)
SELECT b.region, count(h.id) AS eq_events_m6, count(CASE WHEN h.magnitude >= 7 THEN 1 END) AS eq_events_m7,
  count(CASE WHEN dist_km = 0 THEN 1 END) AS eq_inside_events, round_even(count(h.id) / 76, 4) AS eq_rate_per_year,
  any_value(x.magnitude) AS eq_max_magnitude, any_value(x.year) AS eq_max_year, any_value(x.place) AS eq_max_place
FROM {{region_boxes}} b LEFT JOIN hit h USING (region) LEFT JOIN best x ON x.region = b.region GROUP BY b.region""")
def quake_metrics(t):
    return op.quake_metrics(op.quake_exposure(t.quakes, t.region_vertices), t.region_boxes, 76)


@query("strongest_quakes", f"""WITH {QUAKE_SQL} SELECT region, id, rank FROM (SELECT region, id, row_number() OVER (
  PARTITION BY region ORDER BY magnitude DESC, year, id) AS rank FROM hit) q WHERE rank <= 10""")
def strongest_quakes(t):
    return op.strongest_quakes(op.quake_exposure(t.quakes, t.region_vertices)).select("region", "id", "rank")


@query("tracks", """SELECT sid, point_seq, coalesce(usa_wind, wmo_wind) AS wind_kt,
  CASE WHEN usa_wind IS NOT NULL THEN 'US agencies (1-min)' ELSE 'IMD (3-min)' END AS wind_source
FROM {track_points} WHERE basin = 'NI' AND track_type = 'main' AND lat BETWEEN 0 AND 40 AND lon BETWEEN 55 AND 105
  AND coalesce(usa_wind, wmo_wind) IS NOT NULL""")
def tracks(t):
    return op.load_tracks(t.track_points).select("sid", "point_seq", "wind_kt", "wind_source")


@query("storm_exposure", f"""WITH {STORM_SQL} SELECT region, sid, name, season, max_wind_kt,
  round(min_dist_km, 4) AS min_dist_km FROM per""")
def storm_exposure(t):
    out = op.storm_exposure(op.load_tracks(t.track_points), t.region_vertices).drop("wind_source")
    return rounded(out, 4, ["min_dist_km"])


@query("storm_metrics", f"""WITH {STORM_SQL}, best AS (SELECT * FROM (SELECT region, max_wind_kt, name, season, row_number()
    OVER (PARTITION BY region ORDER BY max_wind_kt DESC, season, sid DESC) AS rn FROM per) q WHERE rn = 1)
SELECT b.region, count(p.sid) AS cy_storms_ts, count(CASE WHEN p.max_wind_kt >= 64 THEN 1 END) AS cy_storms_hurricane,
  round_even(count(p.sid) / 46, 4) AS cy_rate_ts_per_year,
  round_even(count(CASE WHEN p.max_wind_kt >= 64 THEN 1 END) / 46, 4) AS cy_rate_hurricane_per_year,
  any_value(x.max_wind_kt) AS cy_max_wind_kt, any_value(x.name) AS cy_max_name, any_value(x.season) AS cy_max_season
FROM {{region_boxes}} b LEFT JOIN per p USING (region) LEFT JOIN best x ON x.region = b.region GROUP BY b.region""")
def storm_metrics(t):
    exposure = op.storm_exposure(op.load_tracks(t.track_points), t.region_vertices)
    return op.storm_metrics(exposure, t.region_boxes, 46)


ZONE_SQL = f"""z AS (SELECT sid, district, state, km, CASE WHEN km < 50 THEN 'danger' WHEN km < 150 THEN 'high'
    WHEN km < 300 THEN 'watch' ELSE 'advisory' END AS zone FROM (SELECT s.sid, d.district, d.state,
      {km_sql('s.lmi_latitude', 's.lmi_longitude', 'd.lat', 'd.lon', '6371.0')} AS km
    FROM {{storms}} s JOIN {{districts}} d ON abs(s.lmi_latitude - d.lat) <= 5) q WHERE km < 500)"""


def storm_centres(t):
    return t.storms.select("sid", F.col("lmi_latitude").alias("lat"), F.col("lmi_longitude").alias("lon"))


@query("storm_zones", f"WITH {ZONE_SQL} SELECT sid, district, state, zone, CAST(floor(km + 0.5) AS BIGINT) AS km FROM z")
def storm_zones(t):
    return op.storm_zones(storm_centres(t), t.districts).select("sid", "district", "state", "zone", "km")


@query("zone_counts", f"""WITH {ZONE_SQL} SELECT sid, count(CASE WHEN zone = 'danger' THEN 1 END) AS danger,
  count(CASE WHEN zone = 'high' THEN 1 END) AS high, count(CASE WHEN zone = 'watch' THEN 1 END) AS watch,
  count(CASE WHEN zone = 'advisory' THEN 1 END) AS advisory, count(*) AS districts FROM z GROUP BY sid""")
def zone_counts(t):
    return op.zone_counts(op.storm_zones(storm_centres(t), t.districts))


@query("largest_nearby", f"""WITH hit AS (SELECT d.district, q.id, q.magnitude, q.place,
    {km_sql('d.lat', 'd.lon', 'q.latitude', 'q.longitude', '6371.0')} AS km FROM {{districts}} d JOIN {{quakes}} q
    ON abs(q.latitude - d.lat) < 5 WHERE q.event_date BETWEEN DATE '2000-12-02' AND DATE '2001-01-01'),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY magnitude DESC, id DESC) AS rn
    FROM hit WHERE km <= 500) q WHERE rn = 1)
SELECT d.district, count(h.id) AS count, any_value(x.magnitude) AS max_magnitude, any_value(x.place) AS place,
  CAST(floor(any_value(x.km) + 0.5) AS BIGINT) AS distance_km FROM {{districts}} d
LEFT JOIN hit h ON h.district = d.district AND h.km <= 500 LEFT JOIN top x ON x.district = d.district GROUP BY d.district""")
def largest_nearby(t):
    return op.largest_nearby(t.districts, t.quakes, "district", "2001-01-01")


SAMPLE_SQL = """g AS (SELECT *, greatest(0.07, sqrt((east - west) * (north - south) / 25)) AS s FROM {region_boxes}),
pts AS (SELECT region, round_even(south + s / 2 + i * s, 4) AS lat, round_even(west + s / 2 + j * s, 4) AS lon
  FROM (SELECT *, unnest(range(100)) AS i FROM g) a, LATERAL (SELECT unnest(range(100)) AS j) b
  WHERE south + s / 2 + i * s < north AND west + s / 2 + j * s < east)"""


@query("sample_points", f"WITH {SAMPLE_SQL} SELECT region, lat, lon FROM pts")
def sample_points(t):
    return op.sample_points(t.region_vertices)


@query("zonal_statistics", """SELECT l_suppkey % 25 AS district, round_even(avg(l_quantity), 1) AS elevation_m,
  round_even(median(l_quantity), 1) AS elevation_median_m,
  round_even(avg(CASE WHEN l_quantity < 10 THEN 1.0 ELSE 0 END) * 100, 1) AS low_lying_pct, count(*) AS elevation_samples
FROM {lineitem} GROUP BY 1""")
def zonal_statistics(t):
    samples = t.lineitem.select((F.col("l_suppkey") % 25).alias("district"), F.col("l_quantity").alias("m"))
    return op.zonal_statistics(samples, "district", "m")


@query("region_area_km2", """SELECT region, CAST(round_even((east - west) * (north - south) * 111.32 * 111.32
  * cos(radians((south + north) / 2)), 0) AS BIGINT) AS area_km2 FROM {region_boxes}""")
def region_area_km2(t):
    shape = op.areas(t.region_vertices).join(op.centroids(t.region_vertices), "region")
    return shape.select("region", F.rint(geo.square_degrees_to_km2(F.col("area"), F.col("latitude")))
                        .cast("long").alias("area_km2"))


@query("wrapped_bounds", """SELECT id FROM {quakes} WHERE latitude BETWEEN -20 AND 20 AND (longitude BETWEEN 150 AND 210
  OR longitude + 360 BETWEEN 150 AND 210 OR longitude - 360 BETWEEN 150 AND 210)""")
def wrapped_bounds(t):
    here = F.col("latitude").between(-20, 20) & geo.lon_within(F.col("longitude"), F.lit(150), F.lit(210))
    return t.quakes.filter(here).select("id")
