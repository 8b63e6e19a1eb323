"""Joins by distance and the nearest region against every boundary mark."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import spatial


def arc(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


def shape(name, corners):
    ring = [*corners, corners[0]]
    return [(name, 0, 0, k, float(x), float(y)) for k, (x, y) in enumerate(ring)]


SHAPES = (shape("tri", [(10, 10), (14.3, 10.2), (11, 15.7)]) + shape("edge", [(176, -3), (180, -3), (180, 2), (176, 2)])
          + shape("cap", [(20, 82), (60, 84), (40, 88)]) + shape("far", [(-120, -40), (-118.5, -40), (-119, -38)]))


def crossing(lat, lon, corners):
    odd = False
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.fixture(scope="module")
def vertices(spark):
    return spark.createDataFrame(SHAPES, "region string, part long, ring long, idx long, lon double, lat double")


@pytest.fixture(scope="module")
def marks(vertices):
    out = {}
    for r in spatial.boundary_points(vertices).collect():
        out.setdefault(r["region"], []).append((r["lat"], r["lon"]))
    return out


def corners(name):
    return [(x, y) for n, _, _, _, x, y in SHAPES if n == name][:-1]


def places(n, seed):
    draw = random.Random(seed)
    near = [(draw.uniform(4, 20), draw.uniform(5, 20)) for _ in range(n)]
    near += [(draw.uniform(-8, 8), draw.choice([draw.uniform(171, 180), draw.uniform(-180, -173)])) for _ in range(n)]
    near += [(draw.uniform(77, 90), draw.uniform(-180, 180)) for _ in range(n)] + [(10.0, 10.0), (0.0, 176.0), (2.0, 180.0), (-90.0, 0.0)]
    return [(f"p{k}", lat, lon) for k, (lat, lon) in enumerate(near)]


@pytest.mark.parametrize("radius", [100.0, 300.0])
def test_reach_equals_every_mark(spark, vertices, marks, radius):
    points = places(120, 1)
    got = spatial.within_reach(spark.createDataFrame(points, "id string, lat double, lon double"), vertices, radius, "lat", "lon").collect()
    wanted = {}
    for name, lat, lon in points:
        for region, own in marks.items():
            km = 0.0 if crossing(lat, lon, corners(region)) else min(arc((lat, lon), m) for m in own)
            if km <= radius:
                wanted[name, region] = km
    assert len(got) == len(wanted) > 30  # nobody is doubled
    assert {(r["id"], r["region"]): pytest.approx(r["dist_km"], abs=1e-6) for r in got} == wanted


def test_nearest_region_equals_every_mark(spark, vertices, marks):
    draw = random.Random(2)
    points = places(25, 3) + [(f"q{k}", draw.uniform(-90, 90), draw.uniform(-180, 180)) for k in range(80)] + [("lost", None, 1.0)]
    df = spark.createDataFrame(points, "id string, lat double, lon double")
    got = {r["id"]: (r["region"], r["how"]) for r in spatial.assign_regions(df, vertices, "id", {"q0": "chosen"}).collect()}
    for name, lat, lon in points:
        around = [r for r in marks if lat is not None and crossing(lat, lon, corners(r))]
        if name == "q0":
            assert got[name] == ("chosen", "override")
        elif lat is None:
            assert got[name] == (None, None)
        elif around:
            assert got[name] == (min(around), "inside")
        else:
            best = min((min(arc((lat, lon), m) for m in own), region) for region, own in marks.items())
            assert got[name][1] == "nearest"
            assert min(arc((lat, lon), m) for m in marks[got[name][0]]) == pytest.approx(best[0], abs=1e-6)


def test_cover_has_cells_of_each_class(vertices):
    rows = spatial.region_cover(vertices.filter("region = 'tri'"), 100.0).agg(
        F.count_if("_within").alias("within"), F.count_if(F.col("_edges").isNotNull()).alias("crossed"),
        F.count_if(~F.col("_within") & F.col("_edges").isNull()).alias("near"), F.max(F.size("_marks")).alias("most")).first()
    assert min(rows["within"], rows["crossed"], rows["near"]) > 10 and rows["most"] < 100
