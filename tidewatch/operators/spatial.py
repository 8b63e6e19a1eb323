"""Polygons, containment, and joins by distance.

Polygons are vertex tables ``(region, part, ring, idx, lon, lat)``: part numbers the
polygons of a region, ring 0 is the outside and further rings are holes. Every spatial join
is an equi join on grid cells with the exact test behind it, so a large point table meets
only the shapes near each point, and a crowded cell is split by the adaptive skew join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.geo import (EARTH_KM, LIVE_EARTH_KM, cell_key, chord_km, haversine_km, neighbour_keys, sphere_axes,
                                     unit_vector)
from tidewatch.operators.ranking import exact_quantile
from tidewatch.session import materialise

# Boundary spacing in degrees, cyclone distance rings in km, sample grid.
BOUNDARY_STEP = 0.05
ZONES = [("danger", 0, 50), ("high", 50, 150), ("watch", 150, 300), ("advisory", 300, 500)]
SAMPLE_STEP = 0.07
SAMPLE_MAX = 25
LOW_LYING_M = 10


# ── shapes ──────────────────────────────────────────────────────────────────


def geojson_vertices(features: DataFrame, name: str) -> DataFrame:
    """Vertex table from features with ``properties`` and a ``geometry`` whose coordinates are text.

    Polygon and MultiPolygon nest to different depths, so each is parsed with its own schema.
    """
    point = "array<double>"
    kind = F.col("geometry.type")
    single = F.from_json("geometry.coordinates", f"array<array<{point}>>")
    many = F.from_json("geometry.coordinates", f"array<array<array<{point}>>>")
    parts = F.when(kind == "Polygon", F.array(single)).when(kind == "MultiPolygon", many)
    rows = features.select(F.trim(F.col(f"properties.{name}")).alias("region"), F.posexplode(parts).alias("part", "_r"))
    rows = rows.select("region", "part", F.posexplode("_r").alias("ring", "_p"))
    rows = rows.select("region", "part", "ring", F.posexplode("_p").alias("idx", "_c"))
    return rows.select("region", *[F.col(c).cast("long").alias(c) for c in ("part", "ring", "idx")],
                       F.col("_c")[0].alias("lon"), F.col("_c")[1].alias("lat"))


def edges(vertices: DataFrame) -> DataFrame:
    """Consecutive vertex pairs of each ring."""
    along = W.partitionBy("region", "part", "ring").orderBy("idx")
    return vertices.select(
        "region", "part", "ring", "idx", F.col("lon").alias("x1"), F.col("lat").alias("y1"),
        F.lead("lon").over(along).alias("x2"), F.lead("lat").over(along).alias("y2")).filter(F.col("x2").isNotNull())


def ring_measures(vertices: DataFrame) -> DataFrame:
    """Planar area and centroid of each ring; a ring without area falls back on its vertex mean."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges(vertices).groupBy("region", "part", "ring").agg(
        (F.sum(cross) / 2).alias("signed"),
        F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"),
        F.avg("x1").alias("mx"), F.avg("y1").alias("my"))
    flat = F.col("signed") == 0
    return sums.select(
        "region", "part", "ring", F.abs("signed").alias("area"),
        F.when(flat, F.col("mx")).otherwise(F.try_divide("sx", F.col("signed") * 6)).alias("lon"),
        F.when(flat, F.col("my")).otherwise(F.try_divide("sy", F.col("signed") * 6)).alias("lat"))


def centroids(vertices: DataFrame) -> DataFrame:
    """Centroid of each region's largest polygon."""
    outer = ring_measures(vertices.filter("ring = 0"))
    best = outer.groupBy("region").agg(F.max_by(F.struct("lat", "lon"), F.struct("area", -F.col("part"))).alias("c"))
    return best.select("region", F.bround("c.lat", 3).alias("latitude"), F.bround("c.lon", 3).alias("longitude"))


def areas(vertices: DataFrame) -> DataFrame:
    """Planar area of each region, holes taken out, and its bounds."""
    size = ring_measures(vertices).groupBy("region").agg(
        F.sum(F.when(F.col("ring") == 0, F.col("area")).otherwise(-F.col("area"))).alias("area"))
    box = vertices.groupBy("region").agg(F.min("lon").alias("west"), F.max("lon").alias("east"),
                                         F.min("lat").alias("south"), F.max("lat").alias("north"))
    return box.join(size, "region")


def boundary_points(vertices: DataFrame, step: float = BOUNDARY_STEP) -> DataFrame:
    """Boundary vertices after cutting every edge into equal pieces no longer than ``step``."""
    length = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1"))
                    + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    pieces = F.greatest(F.ceil(length / step), F.lit(1)).cast("int")
    cut = edges(vertices).withColumn("_n", pieces).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    share = F.col("_k") / F.col("_n")
    return cut.select("region", (F.col("x1") + (F.col("x2") - F.col("x1")) * share).alias("lon"),
                      (F.col("y1") + (F.col("y2") - F.col("y1")) * share).alias("lat"))


# ── containment ─────────────────────────────────────────────────────────────


def inside(lat: Column, lon: Column, ring_edges: Column) -> Column:
    """Odd number of edges crossed by a ray to the east."""
    return F.size(F.filter(ring_edges, lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (
        lon < (e["x2"] - e["x1"]) * F.try_divide(lat - e["y1"], e["y2"] - e["y1"]) + e["x1"]))) % 2 == 1


def around(places: DataFrame, radius_km: float) -> DataFrame:
    """Each place under every cell from which it is in reach; the axes are worked out once per place."""
    axes = dict(zip(("_x", "_y", "_z"), sphere_axes(F.col("lat"), F.col("lon"), radius_km)))
    keys = neighbour_keys([F.col(name) for name in axes])
    return places.withColumns(axes).withColumn("_cell", F.explode(keys)).drop(*axes)


def _row_key(lat: Column, lon: Column) -> Column:
    return F.concat_ws(":", F.lit("in"), F.floor(lat).cast("string"), F.floor(lon).cast("string"))


def inside_cells(vertices: DataFrame) -> DataFrame:
    """One-degree cells that a region spans, with the edges a ray to the east can meet in that row."""
    edge = edges(vertices).select("region", F.struct("x1", "y1", "x2", "y2").alias("e"),
                                  F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2"))))
                                  .alias("_row"))
    rows = edge.groupBy("region", "_row").agg(
        F.collect_list("e").alias("_edges"),
        F.min(F.least("e.x1", "e.x2")).alias("_w"), F.max(F.greatest("e.x1", "e.x2")).alias("_e"))
    cells = rows.withColumn("_col", F.explode(F.sequence(F.floor("_w"), F.floor("_e"))))
    return cells.select("region", F.concat_ws(":", F.lit("in"), F.col("_row").cast("string"), F.col("_col").cast("string"))
                        .alias("_cell"), "_edges")


def reach_cells(vertices: DataFrame, radius_km: float) -> DataFrame:
    """Cells from which a region's boundary can be reached, each with the boundary vertices in reach."""
    spread = around(boundary_points(vertices), radius_km)
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    return spread.groupBy("region", "_cell").agg(
        F.collect_list(F.struct(x.alias("x"), y.alias("y"), z.alias("z"))).alias("_marks"))


def _stored(cells: DataFrame) -> DataFrame:
    """The cell table written out, so that its true size decides whether the join broadcasts it."""
    return materialise(cells, "cells")


def _on_globe(points: DataFrame, lat: str, lon: str) -> DataFrame:
    return points.withColumns(dict(zip(("_gx", "_gy", "_gz"), unit_vector(F.col(lat), F.col(lon)))))


def _nearest_mark() -> Column:
    """Distance to the nearest boundary vertex; straight lines are compared and one arc is taken."""
    def square(m: Column) -> Column:
        dx, dy, dz = m["x"] - F.col("_gx"), m["y"] - F.col("_gy"), m["z"] - F.col("_gz")
        return dx * dx + dy * dy + dz * dz

    return chord_km(F.array_min(F.transform("_marks", square)))


def containing_regions(points: DataFrame, vertices: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Point rows with the region they lie in; points in no region drop out."""
    keyed = points.withColumn("_cell", _row_key(F.col(lat), F.col(lon)))
    return (keyed.join(_stored(inside_cells(vertices)), "_cell")
            .filter(inside(F.col(lat), F.col(lon), F.col("_edges"))).drop("_cell", "_edges"))


def near_boundaries(points: DataFrame, vertices: DataFrame, radius_km: float,
                    lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Point rows with every region whose boundary is within reach, and the distance to it."""
    keyed = _on_globe(points, lat, lon).withColumn("_cell", cell_key(*sphere_axes(F.col(lat), F.col(lon), radius_km)))
    return (keyed.join(_stored(reach_cells(vertices, radius_km)), "_cell").withColumn("dist_km", _nearest_mark())
            .filter(F.col("dist_km") <= radius_km).drop("_cell", "_marks", "_gx", "_gy", "_gz"))


def _grid(lat: Column, lon: Column, size: float) -> Column:
    """Name of the cell of a grid in degrees that a place lies in; columns go round the globe."""
    return F.concat_ws(":", F.floor(lat / size).cast("string"), F.pmod(F.floor(lon / size), F.lit(round(360 / size))).cast("string"))


def _grid_key(size: float) -> Column:
    return F.concat_ws(":", F.col("_row").cast("string"), F.pmod(F.col("_col"), F.lit(round(360 / size))).cast("string"))


def _pieces(vertices: DataFrame, size: float) -> DataFrame:
    """Cells that the boundary of a region passes through, found from its pieces of ``BOUNDARY_STEP`` at most."""
    edge = edges(vertices)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    count = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / BOUNDARY_STEP), F.lit(1)).cast("int")
    cut = edge.withColumn("_n", count).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    a, b = F.col("_k") / F.col("_n"), (F.col("_k") + 1) / F.col("_n")
    ends = {"xa": F.col("x1") + dx * a, "xb": F.col("x1") + dx * b, "ya": F.col("y1") + dy * a, "yb": F.col("y1") + dy * b}

    def cells(one: str, two: str) -> Column:
        low, high = F.least(one, two) - 1e-9, F.greatest(one, two) + 1e-9
        return F.sequence(F.floor(low / size), F.floor(high / size))

    rows = cut.withColumns(ends).select("region", F.explode(cells("ya", "yb")).alias("_row"), cells("xa", "xb").alias("_cols"))
    return rows.select("region", "_row", F.explode("_cols").alias("_col")).distinct().withColumn("_crossed", F.lit(True))


def _shape_cells(vertices: DataFrame, size: float) -> DataFrame:
    """Cells that a region spans: whether the boundary crosses them, whether they lie inside, and the edges of their row."""
    edge = edges(vertices).select("region", F.struct("x1", "y1", "x2", "y2").alias("e"), F.explode(F.sequence(
        F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size))).alias("_row"))
    rows = edge.groupBy("region", "_row").agg(F.collect_list("e").alias("_edges"), F.min(F.least("e.x1", "e.x2")).alias("_w"),
                                              F.max(F.greatest("e.x1", "e.x2")).alias("_e"))
    cells = rows.withColumn("_col", F.explode(F.sequence(F.floor(F.col("_w") / size), F.floor(F.col("_e") / size))))
    cells = cells.join(_pieces(vertices, size), ["region", "_row", "_col"], "left")
    middle = inside((F.col("_row") + 0.5) * size, (F.col("_col") + 0.5) * size, F.col("_edges"))
    cells = cells.withColumn("_within", F.col("_crossed").isNull() & middle).filter(F.col("_crossed") | F.col("_within"))
    return cells.select("region", _grid_key(size).alias("_cell"), "_within", F.when(F.col("_crossed"), F.col("_edges")).alias("_edges"))


def _mark_cells(vertices: DataFrame, radius_km: float, size: float) -> DataFrame:
    """Cells from which a boundary is in reach, each with the marks that can be the nearest one to a place in it.

    No place of a cell is farther from its middle than ``_half``. A mark whose distance to the middle
    is more than that of the nearest by twice as much is never the nearest.
    """
    turn = radius_km / EARTH_KM
    reach = F.lit(math.degrees(turn) + 2 * size)
    marks = boundary_points(vertices)
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    marks = marks.select("region", F.struct(x.alias("x"), y.alias("y"), z.alias("z")).alias("m"), "lat", "lon").withColumn(
        "_row", F.explode(F.sequence(F.floor((F.col("lat") - reach) / size), F.floor((F.col("lat") + reach) / size))))
    marks = marks.filter(F.col("_row").between(math.floor(-90 / size), math.ceil(90 / size) - 1))
    # half the width of the reach on the row's side towards a pole; near one it goes all the way round
    side = F.greatest(F.abs(F.col("_row") * size), F.abs((F.col("_row") + 1) * size))
    spread = F.sin(F.lit(min(turn + math.radians(size), math.pi / 2))) / F.cos(F.radians(F.least(side, F.lit(90.0))))
    wide = F.when((spread < 1) & (F.abs("lat") + reach < 89), F.degrees(F.asin(F.least(spread, F.lit(1.0)))) + 2 * size).otherwise(F.lit(180.0))
    half_turn = round(180 / size)
    col = F.floor(F.col("lon") / size)
    steps = F.least(F.ceil(wide / size).cast("long"), F.lit(half_turn).cast("long"))
    met = marks.withColumn("_col", F.explode(F.sequence(col - steps, col + steps))).withColumn(
        "_col", F.pmod(F.col("_col") + half_turn, F.lit(2 * half_turn)) - half_turn)
    lat, lon = (F.col("_row") + 0.5) * size, (F.col("_col") + 0.5) * size
    cx, cy, cz = unit_vector(lat, lon)
    dx, dy, dz = F.col("m.x") - cx, F.col("m.y") - cy, F.col("m.z") - cz
    met = met.withColumns({"_km": chord_km(dx * dx + dy * dy + dz * dz), "_half": F.lit(EARTH_KM * math.radians(size) * 0.7072)})
    met = met.filter(F.col("_km") <= radius_km + F.col("_half"))
    near = met.groupBy("region", "_row", "_col").agg(F.min("_km").alias("_least"), F.first("_half").alias("_half"),
                                                     F.collect_list(F.struct("_km", "m")).alias("_all"))
    kept = F.filter("_all", lambda s: s["_km"] <= F.col("_least") + 2 * F.col("_half"))
    return near.select("region", _grid_key(size).alias("_cell"), F.array_distinct(F.transform(kept, lambda s: s["m"])).alias("_marks"))


def region_cover(vertices: DataFrame, radius_km: float, size: float = 0.5) -> DataFrame:
    """``(region, _cell, _within, _edges, _marks)``: cells of a grid classed by how a place in them stands to a region.

    Inside for good (``_within``), crossed by the boundary (``_edges`` decide), or outside with the
    boundary in reach (``_marks`` alone). A cell that is out of reach has no row.
    """
    shapes, marks = _shape_cells(vertices, size), _mark_cells(vertices, radius_km, size)
    both = marks.join(shapes, ["region", "_cell"], "full")
    within = F.coalesce("_within", F.lit(False))
    return both.select("region", "_cell", within.alias("_within"), "_edges", F.when(~within, F.col("_marks")).alias("_marks"))


def within_reach(points: DataFrame, vertices: DataFrame, radius_km: float, lat: str, lon: str, size: float = 0.5) -> DataFrame:
    """Point rows with every region in reach: 0 km inside, else the distance to the boundary.

    A point has one cell and meets one row of each region there. Only in cells that the boundary
    crosses edges are tested, and arcs only go to the marks that can be nearest.
    """
    cells = _stored(region_cover(vertices, radius_km, size))
    inner = F.col("_within") | F.coalesce(inside(F.col(lat), F.col(lon), F.col("_edges")), F.lit(False))
    distance = F.when(inner, 0.0).when(F.col("_marks").isNotNull(), _nearest_mark())
    keyed = _on_globe(points, lat, lon).withColumn("_cell", _grid(F.col(lat), F.col(lon), size))
    return (keyed.join(cells, "_cell").withColumn("dist_km", distance).filter(F.col("dist_km") <= radius_km)
            .drop("_cell", "_within", "_marks", "_edges", "_gx", "_gy", "_gz"))


#: First ring of the search for the nearest region in km, and by how many cells' width a ring is searched.
FIRST_RING, RING_CELLS = 60.0, 8


def nearest_regions(points: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """``(key, region)``: the region whose boundary is nearest to each point, ties to the smaller name.

    Points are searched by cell in rings that double, each only for the cells that are still open. A
    ring's cells grow with it, so there are few of them far out. A cell is settled when the ring
    holds every mark that can be nearest to a place in it: those up to the nearest one's distance from
    its middle plus a cell's diagonal. Only these marks meet the points themselves.
    """
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    marks = _stored(boundary_points(vertices).select("region", F.struct(x.alias("x"), y.alias("y"), z.alias("z")).alias("m"), "lat", "lon"))
    rest = materialise(points.select(key, "lat", "lon").dropna(), "open-points")
    found = rest.limit(0).select(key, F.lit("").alias("region"))
    if marks.isEmpty():
        return found
    ring, whole = FIRST_RING, math.pi * EARTH_KM + 1
    while not rest.isEmpty():
        size = 360 / max(round(360 / (math.degrees(ring / EARTH_KM) * 2 / RING_CELLS)), 4)
        diagonal = EARTH_KM * math.radians(size) * 1.4143
        row, col = F.floor(F.col("lat") / size), F.floor(F.col("lon") / size)
        keyed = rest.withColumn("_cell", F.concat_ws(":", row.cast("string"), col.cast("string")))
        cells = keyed.groupBy("_cell").agg(((F.first(row) + 0.5) * size).alias("lat"), ((F.first(col) + 0.5) * size).alias("lon"))
        spots = _on_globe(cells, "lat", "lon").withColumnsRenamed({"_cell": "_spot", "lat": "_clat", "lon": "_clon"})
        spread = around(spots.withColumns({"lat": F.col("_clat"), "lon": F.col("_clon")}), ring).drop("lat", "lon")
        near = marks.withColumn("_cell", cell_key(*sphere_axes(F.col("lat"), F.col("lon"), ring))).join(spread, "_cell")
        dx, dy, dz = F.col("m.x") - F.col("_gx"), F.col("m.y") - F.col("_gy"), F.col("m.z") - F.col("_gz")
        near = near.withColumn("_km", chord_km(dx * dx + dy * dy + dz * dz))
        near = near if ring >= whole else near.filter(F.col("_km") <= ring)
        lists = near.groupBy("_spot", "region").agg(F.min("_km").alias("_least"), F.collect_list(F.struct("_km", "m")).alias("_all"))
        best = lists.groupBy("_spot").agg(F.min("_least").alias("_best"))
        settled = lists.join(best if ring >= whole else best.filter(F.col("_best") + diagonal <= ring), "_spot")
        kept = F.transform(F.filter("_all", lambda s: s["_km"] <= F.col("_best") + diagonal), lambda s: s["m"])
        settled = materialise(settled.filter(F.col("_least") <= F.col("_best") + diagonal)
                              .select(F.col("_spot").alias("_cell"), "region", kept.alias("_marks")), "ring")
        here = _on_globe(keyed, "lat", "lon").join(settled, "_cell").withColumn("_km", _nearest_mark())
        hits = here.groupBy(key).agg(F.min_by("region", F.struct("_km", "region")).alias("region"))
        found = materialise(found.unionByName(hits), "nearest")
        rest = materialise(keyed.join(settled.select("_cell").distinct(), "_cell", "left_anti").drop("_cell"), "open-points")
        ring = min(2 * ring, whole)
    return found


def assign_regions(points: DataFrame, vertices: DataFrame, key: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """One region per point: an override, else the region around it, else the nearest one."""
    found = containing_regions(points, vertices).groupBy(key).agg(F.min("region").alias("region")).withColumn(
        "how", F.lit("inside"))
    outside = points.join(found, key, "left_anti")
    near = nearest_regions(outside, vertices, key).withColumn("how", F.lit("nearest"))
    out = points.join(found.unionByName(near), key, "left")
    if overrides:
        table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
        forced = table[F.col(key)]
        out = out.withColumns({"how": F.when(forced.isNotNull(), "override").otherwise(F.col("how")),
                               "region": F.coalesce(forced, F.col("region"))})
    return out


def label_regions(districts: DataFrame, name: str = "name", state: str = "state") -> DataFrame:
    """Unique label: the name, with the state in brackets where the name is used more than once."""
    uses = districts.groupBy(name).agg(F.count("*").alias("_uses"))
    label = F.when(F.col("_uses") > 1, F.concat(F.col(name), F.lit(" ("), F.col(state), F.lit(")")))
    return districts.join(uses, name).withColumn("district", label.otherwise(F.col(name))).drop("_uses")


# ── exposure ────────────────────────────────────────────────────────────────


def quake_exposure(quakes: DataFrame, vertices: DataFrame, radius_km: float = 300.0, first: int = 1950,
                   last: int = 2025, minimum: float = 6.0) -> DataFrame:
    """One line per region and quake within reach, with the distance to the region (0 inside); the catalogue has a quake once."""
    near = quakes.filter(F.col("year").between(first, last) & (F.col("magnitude") >= minimum))
    hits = within_reach(near, vertices, radius_km, "latitude", "longitude")
    return hits.select("region", "id", "event_date", "year", "month", "magnitude", "place", F.rint("dist_km").alias("dist_km"))


def quake_metrics(exposure: DataFrame, regions: DataFrame, years: int) -> DataFrame:
    """Counts, yearly rate and strongest quake of each region; regions without one keep their line."""
    best = F.max_by(F.struct("magnitude", "year", "place"),
                    F.struct("magnitude", -F.col("year"), F.coalesce("place", F.lit("")), "id"))
    out = exposure.groupBy("region").agg(
        F.count("*").alias("eq_events_m6"), F.count_if(F.col("magnitude") >= 7).alias("eq_events_m7"),
        F.count_if(F.col("dist_km") == 0).alias("eq_inside_events"), best.alias("b"))
    out = regions.select("region").join(out, "region", "left").fillna(
        0, subset=["eq_events_m6", "eq_events_m7", "eq_inside_events"])
    return out.select("region", "eq_events_m6", "eq_events_m7", "eq_inside_events",
                      F.bround(F.col("eq_events_m6") / years, 4).alias("eq_rate_per_year"),
                      F.col("b.magnitude").alias("eq_max_magnitude"), F.col("b.year").alias("eq_max_year"),
                      F.col("b.place").alias("eq_max_place"))


def strongest_quakes(exposure: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` strongest quakes of each region; the limit is applied before the rows are shuffled."""
    order = W.partitionBy("region").orderBy(F.desc("magnitude"), "year", "id")
    return exposure.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def load_tracks(points: DataFrame, basin: str = "NI", box: tuple[float, float, float, float] = (0, 40, 55, 105)) -> DataFrame:
    """Main-track points of one basin and box with the best wind there is and where it comes from."""
    south, north, west, east = box
    return (points.filter((F.col("basin") == basin) & (F.lower("track_type") == "main")
                          & F.col("lat").between(south, north) & F.col("lon").between(west, east))
            .withColumns({"wind_kt": F.coalesce("usa_wind", "wmo_wind"),
                          "wind_source": F.when(F.col("usa_wind").isNotNull(), "US agencies (1-min)")
                          .otherwise("IMD (3-min)")})
            .dropna(subset=["lat", "lon", "wind_kt"]))


def storm_exposure(tracks: DataFrame, vertices: DataFrame, radius_km: float = 100.0, first: int = 1980,
                   last: int = 2025, minimum_kt: float = 34.0) -> DataFrame:
    """One line per region and storm that passed within reach at strength: peak wind there and closest distance."""
    strong = tracks.filter(F.col("season").between(first, last) & (F.col("wind_kt") >= minimum_kt))
    hits = within_reach(strong, vertices, radius_km, "lat", "lon")
    first_point = F.struct("wind_kt", -F.unix_micros("iso_time"), -F.col("point_seq"))
    return hits.groupBy("region", "sid").agg(
        F.max_by(F.struct("name", "season", "wind_kt", "wind_source"), first_point).alias("p"),
        F.min("dist_km").alias("min_dist_km")).select(
        "region", "sid", "p.name", "p.season", F.col("p.wind_kt").alias("max_wind_kt"), "p.wind_source", "min_dist_km")


def storm_metrics(exposure: DataFrame, regions: DataFrame, seasons: int, hurricane_kt: float = 64.0) -> DataFrame:
    best = F.max_by(F.struct("max_wind_kt", "name", "season"), F.struct("max_wind_kt", -F.col("season"), "sid"))
    out = exposure.groupBy("region").agg(
        F.count("*").alias("cy_storms_ts"), F.count_if(F.col("max_wind_kt") >= hurricane_kt).alias("cy_storms_hurricane"),
        best.alias("b"))
    out = regions.select("region").join(out, "region", "left").fillna(0, subset=["cy_storms_ts", "cy_storms_hurricane"])
    return out.select(
        "region", "cy_storms_ts", "cy_storms_hurricane",
        F.bround(F.col("cy_storms_ts") / seasons, 4).alias("cy_rate_ts_per_year"),
        F.bround(F.col("cy_storms_hurricane") / seasons, 4).alias("cy_rate_hurricane_per_year"),
        F.col("b.max_wind_kt").alias("cy_max_wind_kt"), F.col("b.name").alias("cy_max_name"),
        F.col("b.season").alias("cy_max_season"))


def zone_of(km: Column) -> Column:
    """The ring a distance falls in; null beyond the last."""
    out = F.lit(None).cast("string")
    for name, inner, outer in reversed(ZONES):
        out = F.when((km >= inner) & (km < outer), F.lit(name)).otherwise(out)
    return out


def storm_zones(storms: DataFrame, districts: DataFrame) -> DataFrame:
    """Districts inside the distance rings of each storm; storms that reach none drop out."""
    reach = float(ZONES[-1][2])
    places = _stored(around(districts.select("district", "state", "lat", "lon"), reach).withColumnsRenamed(
        {"lat": "_dlat", "lon": "_dlon"}))
    keyed = storms.withColumn("_cell", cell_key(*sphere_axes(F.col("lat"), F.col("lon"), reach)))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("_dlat"), F.col("_dlon"), LIVE_EARTH_KM)
    return (keyed.join(places, "_cell").withColumn("_km", km).withColumn("zone", zone_of(F.col("_km")))
            .filter(F.col("zone").isNotNull()).withColumn("km", F.floor(F.col("_km") + 0.5).cast("long"))
            .drop("_cell", "_dlat", "_dlon", "_km"))


def zone_counts(zones: DataFrame, storm: str = "sid") -> DataFrame:
    return zones.groupBy(storm).agg(*[F.count_if(F.col("zone") == z).alias(z) for z, _, _ in ZONES],
                                    F.count("*").alias("districts"))


def largest_nearby(places: DataFrame, quakes: DataFrame, key: str, now: str, radius_km: float = 500.0,
                   days: int = 30, minimum: float = 2.5) -> DataFrame:
    """Per place: quakes of the last days within reach, and the largest with its distance."""
    recent = quakes.filter((F.col("event_date") >= F.date_sub(F.lit(now).cast("date"), days))
                           & (F.col("event_date") <= F.lit(now).cast("date")) & (F.col("magnitude") >= minimum))
    spots = _stored(around(places.select(key, "lat", "lon"), radius_km).withColumnsRenamed(
        {"lat": "_plat", "lon": "_plon"}))
    keyed = recent.withColumn("_cell", cell_key(*sphere_axes(F.col("latitude"), F.col("longitude"), radius_km)))
    km = haversine_km(F.col("_plat"), F.col("_plon"), F.col("latitude"), F.col("longitude"), LIVE_EARTH_KM)
    hits = keyed.join(spots, "_cell").withColumn("_km", km).filter(F.col("_km") <= radius_km)
    top = F.max_by(F.struct("magnitude", "place", "_km"), F.struct("magnitude", "id"))
    out = hits.groupBy(key).agg(F.count("*").alias("count"), top.alias("t"))
    return places.select(key).join(out, key, "left").select(
        key, F.coalesce("count", F.lit(0)).alias("count"), F.col("t.magnitude").alias("max_magnitude"),
        F.col("t.place").alias("place"), F.floor(F.col("t._km") + 0.5).cast("long").alias("distance_km"))


# ── sampling inside polygons ────────────────────────────────────────────────


def sample_points(vertices: DataFrame) -> DataFrame:
    """A regular grid of points inside each region, at least one.

    The spacing grows with the region, so a region has about 25 points at most.
    """
    shape = areas(vertices).withColumn("_s", F.greatest(F.lit(SAMPLE_STEP), F.sqrt(F.col("area") / SAMPLE_MAX)))

    def steps(low: str, high: str) -> Column:
        count = F.ceil((F.col(high) - F.col(low) - F.col("_s") / 2) / F.col("_s"))
        return F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)) - 1)

    grid = (shape.withColumn("_i", F.explode(steps("south", "north"))).withColumn("_j", F.explode(steps("west", "east")))
            .select("region", (F.col("south") + F.col("_s") / 2 + F.col("_i") * F.col("_s")).alias("lat"),
                    (F.col("west") + F.col("_s") / 2 + F.col("_j") * F.col("_s")).alias("lon")))
    shapes = edges(vertices).groupBy("region").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    kept = grid.join(shapes, "region").filter(inside(F.col("lat"), F.col("lon"), F.col("_edges"))).drop("_edges")
    kept = kept.select("region", F.bround("lat", 4).alias("lat"), F.bround("lon", 4).alias("lon"))
    alone = centroids(vertices).join(kept, "region", "left_anti").select(
        "region", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return kept.unionByName(alone)


def zonal_statistics(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, exact median and share below 10 m over each district's sample points."""
    facts = samples.groupBy(key).agg(
        F.bround(F.avg(value), 1).alias("elevation_m"),
        F.bround(F.avg((F.col(value) < LOW_LYING_M).cast("double")) * 100, 1).alias("low_lying_pct"),
        F.count("*").alias("elevation_samples"))
    middle = exact_quantile(samples.select(key, value), [key], value, 0.5, "_median")
    return facts.join(middle, key).withColumn("elevation_median_m", F.bround("_median", 1)).drop("_median")
