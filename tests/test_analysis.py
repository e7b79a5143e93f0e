import csv
import os
import shutil
import sqlite3
import struct
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from roadloom import demo, queries
from roadloom.functions import crs
from roadloom.functions.geometry import PARTS, from_wkb
from roadloom.functions import sql as sql_functions
from roadloom.operators import associate, dbscan, roads
from roadloom.plans import analysis
from roadloom.render import html, layers, letters, static
from roadloom.sources import columnar, geopackage, shapefile
from roadloom.streaming.associate import associate_stream
from roadloom.streaming.clusters import ClusterState, cluster_stream

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EAST, NORTH = 630_000.0, 2_490_000.0


@pytest.fixture(scope="module")
def layers_on_disk(spark, tmp_path_factory):
    """Points in metres and roads in degrees, written by our own writer."""
    folder = str(tmp_path_factory.mktemp("layers"))
    shapefile.register(spark)
    points = demo.points(spark, SF).select(F.col("point_idx").alias("record_no"), (F.col("x") + EAST).alias("x"), (F.col("y") + NORTH).alias("y"), F.concat(F.lit("é "), F.col("point_idx").cast("string")).alias("name"))
    points.orderBy("record_no").write.format("shapefile").option("crs", "EPSG:32645").mode("overwrite").save(f"{folder}/points.shp")
    moved = F.transform("parts", lambda p: F.transform(p, lambda v: F.struct((v["x"] + EAST).alias("x"), (v["y"] + NORTH).alias("y"))))
    lines = crs.reproject_lines(demo.roads(spark, SF).withColumnRenamed("road_uid", "record_no").withColumn("parts", moved), crs.utm(45), crs.WGS84)
    lines.withColumns({"lanes": F.col("record_no") % 3, "speed": F.lit(12.5), "open": F.lit(True)}).orderBy("record_no").write.format("shapefile").option("crs", "EPSG:4326").mode("overwrite").save(f"{folder}/roads.shp")
    return folder


def test_shapefile_round_trip(spark, layers_on_disk):
    points = spark.read.format("shapefile").load(f"{layers_on_disk}/points.shp")
    assert points.columns == ["record_no", "kind", "x", "y", "name"]
    want = sorted((r["x"] + EAST, r["y"] + NORTH, f"é {r['point_idx']}") for r in demo.points(spark, SF).collect())
    assert sorted((r["x"], r["y"], r["name"]) for r in points.collect()) == want
    lines = spark.read.format("shapefile").load(f"{layers_on_disk}/roads.shp")
    assert dict(lines.dtypes) == {"record_no": "bigint", "kind": "string", "parts": PARTS, "lanes": "bigint", "speed": "double", "open": "boolean"}
    assert lines.where("kind = 'LineString'").count() == 10 and lines.where("kind = 'Point'").count() == 0
    assert shapefile.read_crs(f"{layers_on_disk}/points.shp") == crs.utm(45) and shapefile.read_crs(f"{layers_on_disk}/roads.shp") == crs.WGS84


def test_shapefile_bytes_ranges_and_encoding(spark, tmp_path, monkeypatch):
    """A file made by hand: a null shape, a multi-part line, Latin-1 text, dates and stars; read in ranges of two records."""
    monkeypatch.setattr(shapefile, "RECORDS", 2)
    shapefile.register(spark)
    line = struct.pack("<I4dII2I8d", 3, 0, 0, 3, 3, 2, 4, 0, 2, 0, 0, 1, 1, 2, 2, 3, 3)
    shapes, shp, shx = [line, struct.pack("<I", 0), line], b"", b""
    for k, s in enumerate(shapes):
        shx += struct.pack(">II", 50 + len(shp) // 2, len(s) // 2)
        shp += struct.pack(">II", k + 1, len(s) // 2) + s
    head = lambda n: struct.pack(">I20xI", 9994, 50 + n // 2) + struct.pack("<II8d", 1000, 3, *[0.0] * 8)
    field = lambda name, kind, width, places=0: struct.pack("<11sc4xBB14x", name, kind, width, places)
    fields = field(b"NAME", b"C", 6) + field(b"DAY", b"D", 8) + field(b"N", b"N", 4)
    rows = b" " + "Größe".encode("latin-1").ljust(6) + b"20240229" + b"  12" + b" " + b" " * 6 + b" " * 8 + b"****" + b" " + b"z     " + b"19991231" + b"  -1"
    (tmp_path / "h.shp").write_bytes(head(len(shp)) + shp)
    (tmp_path / "h.shx").write_bytes(head(len(shx)) + shx)
    (tmp_path / "h.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 95, 1, 1, 3, 33 + len(fields), 19) + fields + b"\r" + rows)
    got = [(r["record_no"], r["kind"], r["parts"] and len(r["parts"]), r["NAME"], str(r["DAY"]), r["N"]) for r in spark.read.format("shapefile").load(str(tmp_path / "h.shp")).orderBy("record_no").collect()]
    assert got == [(0, "MultiLineString", 2, "Größe", "2024-02-29", 12), (1, None, None, None, "None", None), (2, "MultiLineString", 2, "z", "1999-12-31", -1)]
    with pytest.raises(Exception, match="absent"):
        spark.read.format("shapefile").load(str(tmp_path / "absent.shp")).schema


def test_geopackage_round_trip(spark, tmp_path):
    geopackage.register(spark)
    path = str(tmp_path / "roads.gpkg")
    demo.roads(spark, SF).withColumn("name", F.lit("é")).write.format("geopackage").option("crs", "EPSG:32645").mode("overwrite").save(path)
    rows = spark.read.format("geopackage").load(path).orderBy("road_uid").collect()
    assert [r["parts"] for r in rows] == [r["parts"] for r in demo.roads(spark, SF).orderBy("road_uid").collect()] and {r["name"] for r in rows} == {"é"}
    with sqlite3.connect(path) as db:
        assert db.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47
        assert db.execute("SELECT table_name, srs_id FROM gpkg_contents").fetchall() == [("roads", 32645)]
        assert db.execute("SELECT count(*) FROM gpkg_spatial_ref_sys WHERE srs_id IN (-1, 0, 4326, 32645)").fetchone()[0] == 4


def test_whole_analysis(spark, layers_on_disk, tmp_path):
    out = str(tmp_path / "out")
    result = analysis.analyze(spark, f"{layers_on_disk}/points.shp", f"{layers_on_disk}/roads.shp", 150.0, 5, 0, out)
    assert set(result.files) == {"summary", "map", "plot", "roads", "points"}
    assert os.path.basename(result.files["summary"]) == "cluster_summary_seg_intol0_eps150.0_mp5.csv"
    with open(result.files["summary"], encoding="utf-8") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == analysis.SUMMARY and len(rows) == result.counts["clusters"] > 0
    assert sorted(int(r["Cluster_ID"]) for r in rows) == list(range(1, len(rows) + 1))
    assert [int(r["Size"]) for r in rows] == sorted((int(r["Size"]) for r in rows), reverse=True)
    assert sum(int(r["Size"]) for r in rows) + result.counts["noise"] == result.counts["points"] == 150
    page = open(result.files["map"], encoding="utf-8").read()
    for text in ("Road Network", "Noise Points", "Cluster 1", "OpenStreetMap", "CartoDB Dark", "Cluster Convex Hulls", "heatLayer", "imperial: true"):
        assert text in page
    assert open(result.files["plot"], "rb").read(8) == b"\x89PNG\r\n\x1a\n"
    drawing = open(result.files["plot"].replace(".png", ".svg"), encoding="utf-8").read()
    assert "Easting (E)" in drawing and "Cluster ID / Type" in drawing and drawing.count("<text") >= 4 + result.counts["clusters"]
    saved = spark.read.format("geopackage").load(result.files["points"])
    assert saved.columns == ["fid", "kind", "parts", "name", "road_uid", "dist_to_road"] and saved.count() == 150


def test_analysis_with_columnar_layers(spark, layers_on_disk, tmp_path):
    result = analysis.analyze(spark, f"{layers_on_disk}/points.shp", f"{layers_on_disk}/roads.shp", 150.0, 5, 0, str(tmp_path), heat=False, plot=False, layer_format="columnar")
    points, system = columnar.read(spark, result.files["points"])
    assert points.count() == 150 and {"name", "road_uid", "dist_to_road", "wkb"} <= set(points.columns) and system == crs.utm(45)
    assert columnar.read(spark, result.files["roads"])[0].count() == 10
    with pytest.raises(ValueError):
        analysis.analyze(spark, "a", "b", layer_format="other")


def test_stops_and_arguments(spark, layers_on_disk, tmp_path):
    points, lines = f"{layers_on_disk}/points.shp", f"{layers_on_disk}/roads.shp"
    for bad in ((1, lines, 1.0, 5, 0), (points, None, 1.0, 5, 0)):
        with pytest.raises(TypeError):
            analysis.analyze(spark, *bad, folder=str(tmp_path))
    for bad in ((0, 5, 0), (1.0, 1, 0), (1.0, 5, -1)):
        with pytest.raises(ValueError):
            analysis.analyze(spark, points, lines, *bad, folder=str(tmp_path))
    with pytest.raises(FileNotFoundError):
        analysis.read_layer(spark, str(tmp_path / "absent.shp"))
    with pytest.raises(analysis.AnalysisError, match="projected"):
        analysis.prepare(demo.points(spark, SF).withColumnRenamed("point_idx", "record_no"), crs.WGS84, demo.roads(spark, SF), crs.WGS84)
    for ending in (".shp", ".shx", ".dbf"):
        shutil.copy(points.replace(".shp", ending), tmp_path / f"bare{ending}")
    with pytest.raises(analysis.AnalysisError, match="reference system"):
        analysis.read_layer(spark, str(tmp_path / "bare.shp"))
    assert analysis.main([]) == 1 and analysis.main(["a.shp", "b.shp", str(tmp_path)]) == 1


def test_reprojection_job(spark, layers_on_disk, tmp_path):
    target = str(tmp_path / "metres.shp")
    assert analysis.reproject(spark, f"{layers_on_disk}/roads.shp", target)
    want = {r["road_uid"]: r["parts"] for r in demo.roads(spark, SF).collect()}
    got = spark.read.format("shapefile").load(target).orderBy("record_no").collect()
    for r, uid in zip(got, sorted(want)):
        for a, b in zip(r["parts"][0], want[uid][0]):
            assert (a["x"], a["y"]) == pytest.approx((b["x"] + EAST, b["y"] + NORTH), abs=1e-6)
    assert not analysis.reproject(spark, target, str(tmp_path / "again.shp")) and not os.path.exists(tmp_path / "again.shp")


def test_layer_guards(spark, tmp_path):
    points = spark.createDataFrame([(0.0, 0.0, 1), (1.0, 1.0, -1), (2.0, 2.0, None)], "x double, y double, cluster long")
    assert static.plot_data(points, crs.WGS84) is None and static.plot_data(points.drop("cluster"), crs.utm(45)) is None
    assert html.map_data(points.where("false"), crs.utm(45)) is None and not html.write_map(str(tmp_path / "no.html"), None)
    data = static.plot_data(points, crs.utm(45), demo.roads(spark, SF), crs.WGS84)
    assert data["roads"] == [] and len(data["none"]) == len(data["noise"]) == len(data["clusters"]) == 1 and data["palette"] == "tab10"
    assert layers.tooltip_fields(spark.createDataFrame([(1, 2, 3)], "road_uid int, parts int, name int")) == ["name"]
    hull = layers.hull_layer(spark.createDataFrame([(1, "N/A")], "cluster long, size string"), points).first()
    assert hull["tooltip"] == "Cluster ID: 1<br>Size Info: N/A"
    shown = {r["cluster"]: r for r in layers.point_layer(points.withColumns({"lat": F.col("y"), "lon": F.col("x")})).collect()}
    assert set(shown) == {1, -1} and shown[-1]["color"] == "grey" and shown[-1]["radius"] == 2 and "Size" not in shown[-1]["popup"] and shown[1]["color"].startswith("#")


def test_stream_equals_batch(spark, tmp_path):
    lines = demo.roads(spark, SF)
    demo.points(spark, SF).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("point_idx long, x double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    associate_stream(stream, lines, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = {(r["point_idx"], r["road_uid"]) for r in associate.associate(demo.points(spark, SF), lines).collect()}
    assert {(r["point_idx"], r["road_uid"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_stateful_clusters_equal_the_batch_result_after_every_batch(spark, tmp_path):
    import random

    rng = random.Random(5)
    adjacent = roads.adjacency(spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "uid_a long, uid_b long"))
    spot = lambda: (rng.randrange(60) / 2, rng.randrange(24) / 2, rng.choice([1, 1, 2, 3, 4, 5, None]))
    order = rng.sample(range(400), 400)
    rows = [(k, *spot()) for k in order] + [(500, float("nan"), 1.0, 1), (501, None, 1.0, 1)]
    batches = [rows[:180], rows[180:300] + rows[20:60] + [(rows[3][0], 0.0, 0.0, 1)], [], rows[300:] + rows[:5]]
    schema = "point_idx long, x double, y double, road_uid long"
    state = ClusterState(spark, str(tmp_path / "state"), adjacent, 1.5, 4)
    seen = {}
    for number, batch in enumerate(batches):
        changed = state.update(spark.createDataFrame(batch, schema).repartition(3), number)
        for r in batch:
            seen.setdefault(r[0], r)
        assert changed.count() <= len(seen)
        if number == 1:
            state.update(spark.createDataFrame(batch, schema).repartition(2), number)  # run again
        want = dbscan.cluster(spark.createDataFrame(list(seen.values()), schema), adjacent, 1.5, 4)
        pick = lambda df: {(r["point_idx"], r["core"], r["cluster"]) for r in df.collect()}
        assert pick(state.labels()) == pick(want)
    assert max(r["cluster"] for r in want.collect()) > 3


def test_stateful_clusters_of_a_stream_touch_few_points(spark, tmp_path):
    schema = "point_idx long, x double, y double, road_uid long"
    for k, x in enumerate((0.0, 0.0, 900.0)):
        rows = [(1000 * k + j, x + j % 7, float(j % 5), 1) for j in range(60)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = ClusterState(spark, str(tmp_path / "state"), roads.adjacency(spark.createDataFrame([], "uid_a long, uid_b long")), 2.0, 5)
    touched = {}
    cluster_stream(stream, state, str(tmp_path / "checkpoint"), lambda rows, n: touched.update({n: rows.count()})).awaitTermination()
    assert sorted(touched.values()) == [60, 60, 120] and {r["cluster"] for r in state.labels().collect()} == {1, 2}


def test_columnar_layers_are_pruned_and_whole(spark, tmp_path):
    path = str(tmp_path / "layer")
    points = spark.range(10_000).select(F.col("id"), (F.col("id") % 100).cast("double").alias("x"), F.floor(F.col("id") / 100).cast("double").alias("y"), F.lit("a").alias("name"))
    odd = spark.createDataFrame([(20_000, None, 1.0, "b"), (20_001, float("nan"), 1.0, None)], "id long, x double, y double, name string")
    columnar.write(points.union(odd).repartition(7), path, crs.utm(45), 500)
    held, system = columnar.read(spark, path)
    assert system == crs.utm(45) and held.count() == 10_002 and len(held.inputFiles()) >= 15
    some, _ = columnar.read(spark, path, (10.0, 10.0, 14.0, 12.0))
    assert some.count() == 15 and len(some.inputFiles()) <= 4
    assert "PushedFilters: [IsNotNull(box_x1)" in some._jdf.queryExecution().toString()
    assert {(r["id"], r["parts"][0][0]["x"]) for r in from_wkb(some.select("id", "wkb")).collect()} == {(100 * y + x, float(x)) for x in range(10, 15) for y in range(10, 13)}
    assert columnar.read(spark, path, (500.0, 500.0, 600.0, 600.0))[0].collect() == []
    columnar.write(points.where("id < 3"), path, crs.utm(45))  # replaces the layer
    assert columnar.read(spark, path)[0].count() == 3
    columnar.write(points.where("false"), path, crs.WGS84)
    assert columnar.read(spark, path)[0].columns == ["id", "name", *columnar.BOX, "wkb"] and columnar.read(spark, path)[0].count() == 0
    with pytest.raises(ValueError):
        columnar.write(points.withColumn("wkb", F.lit(1)), path, crs.WGS84)


def test_columnar_lines_and_rings(spark, tmp_path):
    columnar.write(demo.roads(spark, SF, bend=50), str(tmp_path / "roads"), crs.utm(45), 4)
    rows = from_wkb(columnar.read(spark, str(tmp_path / "roads"))[0])
    want = {(r["road_uid"], str(r["parts"])) for r in demo.roads(spark, SF, bend=50).collect()}
    assert {(r["road_uid"], str(r["parts"])) for r in rows.collect()} == want
    ring = spark.sql("SELECT 1 AS id, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 3D), named_struct('x', 0D, 'y', 0D)) AS ring")
    columnar.write(ring, str(tmp_path / "hulls"), crs.utm(45))
    row = columnar.read(spark, str(tmp_path / "hulls"), (1.5, 2.5, 9.0, 9.0))[0].first()
    assert (row["box_x1"], row["box_y1"], row["box_x2"], row["box_y2"]) == (0.0, 0.0, 2.0, 3.0)


def test_observed_counts_take_no_job_of_their_own(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7 - 1).alias("cluster"))
    spark.sparkContext.setJobGroup("observed", "")
    held, counts = analysis.observed(rows, "seven", n=F.count(F.lit(1)), noise=F.count_if(F.col("cluster") == -1))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed"))
    spark.sparkContext.setJobGroup("other", "")
    assert counts == {"n": 1000, "noise": 143} and jobs == 1 and held.count() == 1000
    assert analysis.observed(rows.where("false"), "none", n=F.count(F.lit(1)))[1] == {"n": 0}


def test_map_of_more_points_than_a_page_holds(spark, monkeypatch):
    monkeypatch.setattr(html, "LIMIT", 120)
    points = spark.range(3000).select((500_000 + F.col("id") * 7 % 3000).alias("x"), (2_400_000 + F.col("id") * 11 % 2900).alias("y"), (F.col("id") % 3 - 1).alias("cluster"))
    data = html.map_data(points.selectExpr("cast(x as double) x", "cast(y as double) y", "cluster"), crs.utm(45))
    assert data["groups"] == [] and data["cells"] and sum(len(v) for v in data["cells"].values()) <= 120
    assert all(sum(r[5] for r in rows) == 3000 for rows in data["cells"].values()) and sum(r[2] for r in data["heat"]) == 3000
    levels = layers.pyramid(layers.geographic(points, crs.utm(45))).groupBy("zoom").agg(F.sum("points").alias("n")).collect()
    assert {r["n"] for r in levels} == {3000} and len(levels) == layers.HIGHEST - layers.LOWEST + 1


def test_guards_count_points_in_cells_too(spark, monkeypatch):
    monkeypatch.setattr(html, "LIMIT", 50)
    got = {r["guard"]: (r["points"], r["heat"]) for r in queries.map_guards(spark, "/root/testdata/sf0.001").collect()}
    assert got == {"no labels": (0, 0), "no points": (0, 0), "not a number": (0, 0), "all": (112, 150)}


def test_ring_cells_and_functions_in_text(spark):
    sql_functions.register(spark)
    for r in range(4):
        cells = {tuple(c) for c in spark.sql(f"SELECT * FROM ring_cells(3, -2, {r})").collect()}
        assert cells == {(3 + i, -2 + j) for i in range(-r, r + 1) for j in range(-r, r + 1) if max(abs(i), abs(j)) == r}
    row = spark.sql("SELECT road_distance(0D, 0D, 3D, 4D) d, road_point_edge(0D, 5D, 2D, 2D, 2D, 2D) p, road_edges_meet(0D, 0D, 2D, 2D, 0D, 2D, 2D, 0D) m, utm_northing(87D, 0D, 45) n").first()
    assert (row["d"], round(row["p"], 6), row["m"], row["n"]) == (5.0, 3.605551, True, 0.0)


def test_letters_and_legend_of_the_picture():
    import zlib

    import numpy as np

    data = {"roads": [[(0.0, 0.0), (10.0, 10.0)]], "noise": [(1.0, 2.0, "")], "none": [], "clusters": [(5.0, 5.0, "#1f77b4")], "legend": [("Cluster 1", "#1f77b4")], "axes": ("E", "N"), "palette": "tab10"}
    body = static.png(data)
    at = body.index(b"IDAT")
    raw = np.frombuffer(zlib.decompress(body[at + 4 : at + 4 + int.from_bytes(body[at - 4 : at], "big")]), np.uint8).reshape(3000, 1 + 3600 * 3)[:, 1:].reshape(3000, 3600, 3)
    dark = (raw == 0).all(axis=2)
    assert dark[240 - 40 : 241, 2940:].any() and dark[:130].any() and dark[2900:].any() and dark[:, :120].any()  # legend, title, both axes
    assert (raw[:, 2940:] == (31, 119, 180)).all(axis=2).any() and (raw == 221).all(axis=2).any()
    blank = np.full((40, 400, 3), 255, np.uint8)
    shapes = set()
    for c in letters.STROKES:
        spot = blank.copy()
        letters.write(spot, c, 5, 30, 20)
        shapes.add(spot.tobytes())
    assert len(shapes) == len(letters.STROKES)


def test_translation_changes_nothing(spark):
    def pairs(dx, dy):
        moved = F.transform("parts", lambda p: F.transform(p, lambda v: F.struct((v["x"] + dx).alias("x"), (v["y"] + dy).alias("y"))))
        return {tuple(r) for r in roads.intersections(demo.roads(spark, SF.replace("0.001", "0.01")).withColumn("parts", moved)).collect()}

    assert pairs(0, 0) == pairs(-5000, 70_000) and len(pairs(0, 0)) == 101


def test_works_without_the_corpus_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert 'cluster_summary' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); assert set(e.oracle_sql()) == set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_sql_nearest_takes_finer_cells_where_lines_and_places_are_dense(spark):
    points = spark.createDataFrame([(k, float(k % 50) * 8, float(k // 50) * 8) for k in range(2500)], "point_idx long, x double, y double")
    lines = spark.createDataFrame([(k, 0.0, 10.0 * (k % 40), 400.0, 10.0 * (k % 40)) for k in range(120)], "road_uid long, x1 double, y1 double, x2 double, y2 double")
    assert sql_functions._side(points, lines, 50.0) < 50 and sql_functions._side(points, lines.where("false"), 50.0) == 50.0
    got = {r["point_idx"]: (r["road_uid"], round(r["dist_to_road"], 9)) for r in sql_functions.nearest(points, lines, 50.0, 800.0).collect()}
    assert got == {k: min((abs(k // 50 * 8.0 - 10 * j), j) for j in range(40))[::-1] for k in range(2500)}


def test_new_cores_of_a_batch_are_named_by_their_cluster(spark, tmp_path, monkeypatch):
    """Only clusters and old components are joined up, not every new core."""
    from roadloom.streaming import clusters

    state = ClusterState(spark, str(tmp_path / "state"), roads.adjacency(spark.createDataFrame([], "uid_a long, uid_b long")), 2.0, 5)
    seen, real = [], clusters.connected_components
    monkeypatch.setattr(clusters, "connected_components", lambda rows, *a, **k: (seen.append(rows.count()), real(rows, *a, **k))[1])
    for n in range(2):
        state.update(spark.createDataFrame([(2 * k + n, k % 40 / 10 + 50 * (k // 200), k % 7 / 10, 1) for k in range(400)], "point_idx long, x double, y double, road_uid long"), n)
    assert {(r["cluster"], r["count"]) for r in state.labels().groupBy("cluster").count().collect()} == {(1, 400), (2, 400)}
    assert max(seen[:2]) <= 2
