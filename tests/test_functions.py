import math
import random

import pytest
from pyspark.sql import functions as F

from roadloom.functions import crs, geometry


def test_crs_text_and_codes():
    text = 'PROJCS["WGS_1984_UTM_Zone_45N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",87.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
    assert crs.parse(text) == crs.utm(45) == crs.parse("epsg:32645") and crs.utm(45).srid == 32645
    for c in (crs.WGS84, crs.utm(1), crs.utm(60, north=False)):
        assert crs.parse(crs.to_wkt(c)) == c and crs.from_srid(c.srid) == c
    for bad in ("EPSG:3857", "nothing", text.replace("Transverse_Mercator", "Mercator"), text.replace('"Meter",1.0', '"Foot",0.3048')):
        with pytest.raises(ValueError):
            crs.parse(bad)
    assert crs.utm(45).axes == ("E", "N") and not crs.WGS84.projected


def test_projection_of_known_places(spark):
    zone = crs.utm(45)
    rows = spark.createDataFrame([(0, 87.0, 0.0), (1, 87.0, 45.0), (2, 87.0, -45.0), (3, 88.3639, 22.5726)], "k long, lon double, lat double")
    x, y = crs.project(F.col("lon"), F.col("lat"), zone)
    got = {r["k"]: (r["x"], r["y"]) for r in rows.select("k", x.alias("x"), y.alias("y")).collect()}
    arc = 0.9996 * 4984944.378  # metres of meridian from the equator to 45 degrees
    assert got[0] == pytest.approx((500_000, 0), abs=1e-6) and got[1] == pytest.approx((500_000, arc), abs=1e-3) and got[2] == pytest.approx((500_000, -arc), abs=1e-3)
    assert 630_000 < got[3][0] < 650_000 and 2_480_000 < got[3][1] < 2_510_000


def test_projection_round_trip(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.uniform(83.5, 90.5), rng.uniform(-80, 84)) for _ in range(300)], "lon double, lat double")
    points = rows.select(F.col("lon").alias("x"), F.col("lat").alias("y"), "lon", "lat")
    back = crs.reproject_points(crs.reproject_points(points, crs.WGS84, crs.utm(45)), crs.utm(45), crs.WGS84)
    worst = back.agg(F.max(F.abs(F.col("x") - F.col("lon"))), F.max(F.abs(F.col("y") - F.col("lat")))).first()
    assert max(worst) < 1e-11
    same = crs.reproject_lines(rows.select(F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("parts"), "lon", "lat"), crs.WGS84, crs.utm(45))
    x, y = crs.project(F.col("lon"), F.col("lat"), crs.utm(45))
    assert same.agg(F.max(F.abs(F.col("parts")[0][0]["x"] - x) + F.abs(F.col("parts")[0][0]["y"] - y))).first()[0] < 1e-6
    assert crs.reproject_points(points, crs.WGS84, crs.WGS84) is not None


def test_distance_checks_its_arguments():
    assert geometry.distance((0, 0), [3, 4]) == 5
    with pytest.raises(TypeError):
        geometry.distance("ab", (1, 2))
    with pytest.raises(ValueError):
        geometry.distance((1, 2, 3), (1, 2))


def touches(p, q):
    """Whether two lattice edges share a point, in whole numbers."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: turn(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    a, b, c, d = *p, *q
    if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
        return True
    return on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b)


def test_edges_intersect_like_whole_numbers(spark):
    rng = random.Random(2)
    spot = lambda: (rng.randrange(5), rng.randrange(5))
    rows = [(spot(), spot(), spot(), spot()) for _ in range(1500)]
    names = [f"{e}{c}{k}" for e in "pq" for k in (1, 2) for c in "xy"]
    table = spark.createDataFrame([tuple(float(v) for s in r for v in s) for r in rows], ", ".join(f"{n} double" for n in names))
    edge = lambda e: {f"{c}{k}": F.col(f"{e}{c}{k}") for k in (1, 2) for c in "xy"}
    got = table.select(*names, geometry.edges_intersect(edge("p"), edge("q")).alias("hit"), geometry.edges_squared(edge("p"), edge("q")).alias("d2")).collect()
    for r in got:
        p, q = [((r[f"{e}x1"], r[f"{e}y1"]), (r[f"{e}x2"], r[f"{e}y2"])) for e in "pq"]
        assert r["hit"] == touches(p, q) and (r["d2"] == 0) == r["hit"]


def test_validity(spark):
    line = lambda *v: [[{"x": float(x), "y": float(y)} for x, y in v]]
    rows = [(0, line((0, 0), (1, 1))), (1, line((0, 0), (0, 0))), (2, []), (3, line((0, 0), (math.nan, 1))), (4, None), (5, line((0, 0), (1, 1)) + line((2, 2), (2, 2))), (6, line())]
    table = spark.createDataFrame(rows, f"k long, parts {geometry.PARTS}")
    got = {r["k"]: (r["v"], r["e"]) for r in table.select("k", geometry.valid_line(F.col("parts")).alias("v"), geometry.non_empty(F.col("parts")).alias("e")).collect()}
    assert got == {0: (True, True), 1: (False, True), 2: (False, False), 3: (False, True), 4: (False, False), 5: (False, True), 6: (False, False)}


def test_wkb_of_all_kinds(spark):
    line, ring = [(0.0, 0.0), (1.5, 2.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert geometry.parse_wkb(geometry.point_wkb(1.5, -2.0)) == ("Point", [(1.5, -2.0)])
    assert geometry.parse_wkb(geometry.line_wkb([line])) == ("LineString", [line])
    assert geometry.parse_wkb(geometry.line_wkb([line, ring])) == ("MultiLineString", [line, ring])
    assert geometry.parse_wkb(geometry.polygon_wkb(ring)) == ("Polygon", [ring])
    rows = spark.createDataFrame([(1, [[{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}]]), (2, None)], f"k long, parts {geometry.PARTS}")
    back = {r["k"]: (r["kind"], r["parts"]) for r in geometry.from_wkb(geometry.with_wkb(rows).drop("parts")).collect()}
    assert back[1][0] == "LineString" and [(v["x"], v["y"]) for v in back[1][1][0]] == [(0.0, 1.0), (2.0, 3.0)] and back[2] == (None, None)
