"""One query per operator family over the driver's tables, and the same in SQL.

Points come from ``customer`` and roads from ``supplier`` (:mod:`roadloom.demo`), on an integer lattice, so predicates are
exact in both engines; other numbers are rounded to six places on both sides.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadloom import demo
from roadloom.functions import crs, geometry
from roadloom.functions import sql as sql_functions
from roadloom.operators import associate, clean, dbscan, roads, summarize
from roadloom.plans import analysis
from roadloom.render import html, layers
from roadloom.session import cut, ensure_checkpoint_dir, ship
from roadloom.sources import columnar, geopackage, shapefile
from roadloom.streaming.clusters import ClusterState

EPS, MIN_PTS, TOLERANCE, BUFFER = 60.0, 5, 25.0, 80.0
Query = Callable[[SparkSession, str], DataFrame]


def _associated(spark: SparkSession, sf_dir: str, snap: int = 1) -> tuple[DataFrame, DataFrame]:
    """Associated points and the adjacency of roads. Of roads of one geometry points get the lowest number, so that stands for all."""
    lines = cut(roads.unlike(demo.roads(spark, sf_dir)))
    return cut(associate.associate(demo.points(spark, sf_dir, snap), lines)), cut(roads.adjacency(roads.intersections_unlike(lines), distinct=False))


def labelled(spark: SparkSession, sf_dir: str, snap: int = 1, eps: float = EPS) -> DataFrame:
    points, adjacent = _associated(spark, sf_dir, snap)
    return cut(dbscan.cluster(points, adjacent, eps, MIN_PTS))


def _whole(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with gaps: some coordinates are null or not a number."""
    rows = demo.points(spark, sf_dir).withColumnRenamed("point_idx", "record_no")
    key = F.col("record_no")
    return rows.withColumns({"x": F.when(key % 17 == 0, None).when(key % 19 == 0, float("nan")).otherwise(F.col("x")), "kind": F.when(key % 23 == 0, "LineString").otherwise("Point")})


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some have no length, no parts or another kind."""
    rows = demo.roads(spark, sf_dir).withColumnRenamed("road_uid", "record_no")
    key, part = F.col("record_no"), F.col("parts")[0]
    parts = F.when(key % 10 == 3, F.array(F.array(part[0], part[0]))).when(key % 10 == 7, F.array().cast(geometry.PARTS)).otherwise(F.col("parts"))
    return rows.select("record_no", parts.alias("parts"), F.when(key % 11 == 0, "Point").otherwise("LineString").alias("kind"))


def point_clean(spark, sf_dir):
    return clean.clean_points(_raw_points(spark, sf_dir)).select(*_whole("record_no", "point_idx"), "x", "y")


def road_clean(spark, sf_dir):
    return clean.clean_roads(_raw_lines(spark, sf_dir), on_invalid="drop").select(*_whole("record_no", "road_uid"), F.size(F.col("parts")[0]).cast("long").alias("vertices"))


def road_audit(spark, sf_dir):
    return clean.audit_lines(_raw_lines(spark, sf_dir)).select(*_whole("total", "invalid", "empty"))


def road_uid_dense(spark, sf_dir):
    return clean.key_roads(_raw_lines(spark, sf_dir)).select(*_whole("record_no", "road_uid"))


def road_edges(spark, sf_dir):
    return roads.edges(demo.roads(spark, sf_dir, bend=50)).select(*_whole("road_uid"), "x1", "y1", "x2", "y2")


def road_intersections(spark, sf_dir):
    return roads.intersections(demo.roads(spark, sf_dir))


def road_intersections_bent(spark, sf_dir):
    return roads.intersections(demo.roads(spark, sf_dir, bend=50))


def road_intersections_tol_compat(spark, sf_dir):
    return roads.intersections(demo.roads(spark, sf_dir), TOLERANCE, "compat")


def road_intersections_tol_effective(spark, sf_dir):
    return roads.intersections(demo.roads(spark, sf_dir), TOLERANCE, "effective")


def road_intersections_tol_buffer(spark, sf_dir):
    return roads.intersections(demo.roads(spark, sf_dir), BUFFER, "buffer")


def road_adjacency(spark, sf_dir):
    return roads.adjacency(roads.intersections(demo.roads(spark, sf_dir)), distinct=False)


def road_neighbour_lists(spark, sf_dir):
    lines = demo.roads(spark, sf_dir)
    rows = roads.neighbour_lists(lines, roads.adjacency(roads.intersections(lines)))
    return rows.select("road_uid", F.array_join("neighbours", ",").alias("neighbours"), F.size("neighbours").cast("long").alias("degree"))


def road_reach_1hop(spark, sf_dir):
    return roads.reach_of(demo.roads(spark, sf_dir))


def isolated_roads(spark, sf_dir):
    return road_neighbour_lists(spark, sf_dir).where("degree = 0").select("road_uid")


def nearest_road(spark, sf_dir):
    rows = associate.associate(demo.points(spark, sf_dir), demo.roads(spark, sf_dir))
    return rows.select("point_idx", *_whole("road_uid"), *_six("dist_to_road"))


def nearest_road_ties(spark, sf_dir):
    """Points on the ends of roads; equally near roads are resolved to the lowest number."""
    lines = demo.roads(spark, sf_dir)
    ends = lines.select("road_uid", F.posexplode(F.col("parts")[0]).alias("k", "v")).select((F.col("road_uid") * 2 + F.col("k")).alias("point_idx"), "v.x", "v.y")
    rows = associate.associate(ends, lines)
    return rows.select("point_idx", *_whole("road_uid"), *_six("dist_to_road"))


def association_counts(spark, sf_dir):
    return associate.association_counts(associate.associate(demo.points(spark, sf_dir), demo.roads(spark, sf_dir)))


def eps_pairs(spark, sf_dir):
    return dbscan.eps_pairs(_associated(spark, sf_dir)[0], EPS).select("i", "j")


def constrained_pairs(spark, sf_dir):
    points, adjacent = _associated(spark, sf_dir)
    return dbscan.constrained_pairs(points, adjacent, EPS).select("i", "j")


def unassociated_pairs(spark, sf_dir):
    """Points over 100 from their road count as without one: these pair among themselves only."""
    points = associate.associate(demo.points(spark, sf_dir), demo.roads(spark, sf_dir))
    points = points.withColumn("road_uid", F.when(F.col("dist_to_road") > 100, None).otherwise(F.col("road_uid")))
    return dbscan.unassociated_pairs(points, EPS).select("i", "j")


def core_points(spark, sf_dir):
    return labelled(spark, sf_dir).where("core").select("point_idx")


def border_points(spark, sf_dir):
    return labelled(spark, sf_dir).where("not core and cluster > 0").select("point_idx", "cluster")


def noise_points(spark, sf_dir):
    return labelled(spark, sf_dir).where("cluster = -1").select("point_idx")


def core_components(spark, sf_dir):
    return labelled(spark, sf_dir).where("core").groupBy("cluster").agg(F.min("point_idx").alias("first_core"), F.count(F.lit(1)).alias("cores"))


def constrained_dbscan(spark, sf_dir):
    return labelled(spark, sf_dir).select("point_idx", "cluster")


def constrained_dbscan_snapped(spark, sf_dir):
    return labelled(spark, sf_dir, 50).select("point_idx", "cluster")


def plain_dbscan_contrast(spark, sf_dir):
    return dbscan.cluster_plain(demo.points(spark, sf_dir).withColumn("road_uid", F.lit(0)), EPS, MIN_PTS).select("point_idx", "cluster")


def cluster_sizes(spark, sf_dir):
    return summarize.sizes(labelled(spark, sf_dir))


def cluster_centroids_distinct(spark, sf_dir):
    return summarize.centroids(labelled(spark, sf_dir, 50)).select("cluster", *_six("x", "y"))


def cluster_hull_area(spark, sf_dir):
    return summarize.hulls(labelled(spark, sf_dir, 50)).select("cluster", *_six("area"))


def cluster_summary(spark, sf_dir):
    rows = summarize.summary(labelled(spark, sf_dir, 50))
    return rows.select("Cluster_ID", "Size", *_six("Centroid_X", "Centroid_Y", "Hull_Area"))


def run_counts(spark, sf_dir):
    return summarize.run_counts(labelled(spark, sf_dir))


def _degrees(points: DataFrame) -> DataFrame:
    """Lattice coordinates read as hundredths of a degree."""
    return points.withColumns({"lon": F.col("x") / 100, "lat": F.col("y") / 100})


def map_center(spark, sf_dir):
    return layers.map_center(_degrees(demo.points(spark, sf_dir))).select(*_six("lat", "lon"))


def cluster_palette_index(spark, sf_dir):
    return layers.palette_index(labelled(spark, sf_dir)).select("cluster", "position", *_six("share"))


def popup_text(spark, sf_dir):
    rows = layers.point_layer(_degrees(labelled(spark, sf_dir)))
    return rows.select("point_idx", "group_name", *_whole("radius"), "popup")


def palette_choice(spark, sf_dir):
    rows = demo.points(spark, sf_dir).select((F.col("point_idx") % 30).alias("clusters")).distinct()
    return rows.select("clusters", layers.palette_choice(F.col("clusters")).alias("palette"))


def hull_sizes_join(spark, sf_dir):
    rows = labelled(spark, sf_dir, 50)
    asked = spark.range(1, 151).select(F.col("id").alias("cluster"))
    return layers.with_size(asked, rows)


def legend_labels(spark, sf_dir):
    return layers.legend(labelled(spark, sf_dir)).select("label")


def plot_groups(spark, sf_dir):
    """Labels as text, some of them not numbers: -2 on the plot."""
    rows = demo.points(spark, sf_dir).select(F.when(F.col("point_idx") % 5 == 0, "x").otherwise((F.col("point_idx") % 4 - 1).cast("string")).alias("cluster"))
    return layers.plot_cluster(rows).groupBy("cluster_plot").agg(F.count(F.lit(1)).alias("points"))


def _lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.points(spark, sf_dir)
    return rows.select("point_idx", (84 + F.col("x") * 0.003).alias("lon"), (F.col("y") * 0.04 - 40).alias("lat"))


def utm_forward(spark, sf_dir):
    x, y = crs.project(F.col("lon"), F.col("lat"), crs.utm(45))
    return _lonlat(spark, sf_dir).select("point_idx", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def utm_roundtrip(spark, sf_dir):
    zone = crs.utm(45)
    rows = _lonlat(spark, sf_dir)
    x, y = crs.project(F.col("lon"), F.col("lat"), zone)
    lon, lat = crs.unproject(F.col("x"), F.col("y"), zone)
    return rows.select("point_idx", x.alias("x"), y.alias("y")).select("point_idx", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


def point_distance(spark, sf_dir):
    rows = demo.points(spark, sf_dir)
    return rows.select("point_idx", F.round(F.hypot(F.col("x") - 1000, F.col("y") - 1000), 6).alias("distance"))


def sentinel_coerce(spark, sf_dir):
    key = F.col("point_idx")
    raw = F.when(key % 3 == 0, None).when(key % 3 == 1, key.cast("string")).otherwise(F.concat(F.lit("n"), key.cast("string")))
    return demo.points(spark, sf_dir).select("point_idx", clean.to_key(raw).alias("road_uid"))


def wkb_roundtrip(spark, sf_dir):
    rows = geometry.from_wkb(geometry.with_wkb(demo.points(spark, sf_dir)).select("point_idx", "wkb"))
    vertex = F.col("parts")[0][0]
    return rows.select("point_idx", "kind", vertex["x"].alias("x"), vertex["y"].alias("y"))


def _target(spark: SparkSession, name: str) -> str:
    """A fresh name in the shared folder for a layer of one file, which only a mounted file system can hold."""
    place = urlparse(_folder(spark))
    if place.scheme not in ("", "file"):
        raise RuntimeError(f"single-file layers need a mounted shared folder, not {place.scheme}://; columnar layers don't")
    os.makedirs(place.path)
    return f"{place.path}/{name}"


def _folder(spark: SparkSession) -> str:
    """A fresh folder name in the shared folder, whatever file system that is on."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/layers-{uuid.uuid4().hex}"


def _placed(rows: DataFrame) -> DataFrame:
    """Add ``position``, the place of each row in the order of ``rows`` (a few rows for each cluster)."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long") - 1)


def shapefile_points(spark, sf_dir):
    """Points written as a shapefile and read again."""
    shapefile.register(spark)
    path = _target(spark, "points.shp")
    rows = demo.points(spark, sf_dir).select("point_idx", "x", "y", F.concat(F.lit("né "), F.col("point_idx").cast("string")).alias("name"))
    rows.orderBy("point_idx").write.format("shapefile").option("crs", "EPSG:32645").mode("overwrite").save(path)
    held, system = analysis.read_layer(spark, path)
    return held.select(*_whole("record_no", "point_idx"), "kind", "x", "y", "name", F.lit(system.srid).cast("long").alias("srid"))


def shapefile_lines(spark, sf_dir):
    """Roads written as a shapefile and read again, one row for each vertex."""
    shapefile.register(spark)
    path = _target(spark, "roads.shp")
    rows = demo.roads(spark, sf_dir, bend=50).select("parts", F.col("road_uid").alias("uid"), (F.col("road_uid") / 8).alias("width"))
    rows.orderBy("uid").write.format("shapefile").option("crs", "EPSG:32645").mode("overwrite").save(path)
    held, _ = analysis.read_layer(spark, path)
    return held.select(F.col("uid").cast("long").alias("road_uid"), "kind", "width", F.posexplode(F.col("parts")[0]).alias("k", "v")).select("road_uid", "kind", "width", F.col("k").cast("long").alias("k"), "v.x", "v.y")


def geopackage_roads(spark, sf_dir):
    """Roads written as a GeoPackage and read again, one row for each vertex."""
    geopackage.register(spark)
    path = _target(spark, "roads.gpkg")
    demo.roads(spark, sf_dir).write.format("geopackage").option("crs", "EPSG:32645").mode("overwrite").save(path)
    held = spark.read.format("geopackage").load(path)
    return held.select(*_whole("road_uid"), F.posexplode(F.col("parts")[0]).alias("k", "v")).select("road_uid", F.col("k").cast("long").alias("k"), "v.x", "v.y")


def geopackage_points(spark, sf_dir):
    """Associated points written as a GeoPackage and read again."""
    geopackage.register(spark)
    path = _target(spark, "points.gpkg")
    rows = associate.associate(demo.points(spark, sf_dir), demo.roads(spark, sf_dir))
    rows.select("x", "y", "point_idx", "road_uid", "dist_to_road").write.format("geopackage").option("crs", "EPSG:32645").mode("overwrite").save(path)
    vertex = F.col("parts")[0][0]
    return spark.read.format("geopackage").load(path).select(*_whole("point_idx", "road_uid"), vertex["x"].alias("x"), vertex["y"].alias("y"), *_six("dist_to_road"))


def summary_csv(spark, sf_dir):
    """The summary file, largest clusters first, as it reads."""
    path = analysis.output_names(os.path.dirname(_target(spark, "")), EPS, MIN_PTS, 0)["summary"]
    analysis.write_summary(path, summarize.summary(labelled(spark, sf_dir, 50)))
    schema = "Cluster_ID long, Size long, Centroid_X double, Centroid_Y double, Hull_Area double"
    rows = _placed(spark.read.csv(f"file:{path}", header=True, schema=schema))
    return rows.select("position", "Cluster_ID", "Size", *_six("Centroid_X", "Centroid_Y", "Hull_Area"), F.lit(os.path.basename(path)).alias("file"))


def summary_ordered(spark, sf_dir):
    return _placed(summarize.ordered(summarize.summary(labelled(spark, sf_dir, 50)).select("Cluster_ID", "Size")))


def legend_ordered(spark, sf_dir):
    return _placed(layers.legend(labelled(spark, sf_dir)).select("label"))


def failed_join(spark, sf_dir):
    """Points associated with no roads at all."""
    rows = associate.associate(demo.points(spark, sf_dir), demo.roads(spark, sf_dir).where("false"))
    return rows.select("point_idx", *_whole("road_uid"), F.col("dist_to_road").isNull().alias("no_distance"))


def merged_uid(spark, sf_dir):
    """The key after a join that suffixed it, and where it is missing."""
    rows = demo.points(spark, sf_dir)
    suffixed = clean.merge_uid(rows.select("point_idx", F.lit(5).alias("road_uid"), (F.col("point_idx") % 3).alias("road_uid_road")))
    missing = clean.merge_uid(rows.select(-F.col("point_idx").alias("point_idx")).toDF("point_idx"))
    return suffixed.select(*_whole("point_idx", "road_uid")).union(missing.select(*_whole("point_idx", "road_uid")))


def unassociated_counts(spark, sf_dir):
    """Counts where every third point has no road and every fifth a null one."""
    key = F.col("point_idx")
    uid = F.when(key % 5 == 0, None).when(key % 3 == 0, -999).otherwise(key)
    return associate.association_counts(demo.points(spark, sf_dir).withColumn("road_uid", uid))


def road_tooltips(spark, sf_dir):
    rows = demo.roads(spark, sf_dir).withColumns({"name": F.concat(F.lit("road "), F.col("road_uid").cast("string")), "lanes": F.when(F.col("road_uid") % 4 > 0, F.col("road_uid") % 4)})
    return layers.road_layer(rows, crs.utm(45)).select("road_uid", "tooltip", F.get_json_object("geojson", "$.type").alias("shape"))


def palette_listed(spark, sf_dir):
    """Colours of the ten-colour palette by a cluster's place."""
    return layers.palette(labelled(spark, sf_dir), "tab10").select("cluster", "position", "color")


def centroid_popups(spark, sf_dir):
    rows = labelled(spark, sf_dir, 50)
    return layers.centroid_layer(summarize.centroids(rows), rows).select("cluster", "size", "popup")


def hull_tooltips(spark, sf_dir):
    rows = labelled(spark, sf_dir, 50)
    return layers.hull_layer(summarize.hulls(rows), rows).select("cluster", "size", "tooltip")


def hull_tooltips_text(spark, sf_dir):
    """Sizes that aren't numbers are named otherwise."""
    rows = labelled(spark, sf_dir, 50)
    sized = summarize.hulls(rows).withColumn("size", F.concat(F.lit("about "), F.col("cluster").cast("string")))
    return layers.hull_layer(sized, rows).select("cluster", "tooltip")


def map_centre_degrees(spark, sf_dir):
    """The centre of points of zone 45N, in degrees, from the mean of all of them."""
    rows = demo.points(spark, sf_dir).select((F.col("x") * 0 + 500_000).alias("x"), (F.col("y") * 0).alias("y"))
    return layers.map_center(layers.geographic(rows, crs.utm(45))).select(F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


def crs_tests(spark, sf_dir):
    """Systems of the zones that customers' numbers fall into, north and south."""
    zones = demo.points(spark, sf_dir).select((F.col("point_idx") % 60 + 1).alias("zone")).distinct().collect()  # 60 at most
    held = [(f"EPSG:{base + r['zone']}", crs.parse(f"EPSG:{base + r['zone']}")) for r in zones for base in (32600, 32700)] + [("EPSG:4326", crs.parse("EPSG:4326"))]
    return spark.createDataFrame([(n, c.projected, c.unit, c.axes[0], c.srid, c == crs.utm(45)) for n, c in held], "name string, projected boolean, unit string, axis string, srid long, same boolean")


def utm_known_places(spark, sf_dir):
    """Points on the central meridian, on the equator and 45 degrees off it, where the meridian's arc is published."""
    x, y = crs.project(F.lit(87.0), (F.col("point_idx") % 3 - 1) * 45.0, crs.utm(45))
    return demo.points(spark, sf_dir).select("point_idx", F.round(x, 2).alias("easting"), F.round(y, 2).alias("northing"))


def argument_checks(spark, sf_dir):
    """Which arguments made from customers' rows are refused."""
    cases = demo.points(spark, sf_dir).select((F.col("x") % 3 - 1).alias("eps"), (F.col("point_idx") % 5).cast("int").alias("min_pts"), (F.col("y") % 3 - 1).alias("tolerance")).distinct().collect()  # 45 at most
    out = []
    for r in cases:
        try:
            analysis.check_arguments("p", "l", r["eps"], r["min_pts"], r["tolerance"])
            out.append((*r, "taken"))
        except (TypeError, ValueError):
            out.append((*r, "refused"))
    return spark.createDataFrame(out, "eps double, min_pts int, tolerance double, outcome string").withColumn("min_pts", F.col("min_pts").cast("long"))


def output_files(spark, sf_dir):
    """Names of result files for parameters made from suppliers' rows."""
    held = demo.roads(spark, sf_dir).select((F.col("road_uid") % 7 + 2).cast("int").alias("min_pts")).distinct().collect()  # seven at most
    return spark.createDataFrame([(r["min_pts"], k, v) for r in held for k, v in analysis.output_names("out", r["min_pts"] * 30.0, r["min_pts"], 0).items()], "min_pts long, kind string, path string")


def point_distance_checked(spark, sf_dir):
    """The scalar function that checks its arguments, row by row."""
    far = F.udf(lambda x, y: geometry.distance((x, y), [1000.0, 1000.0]), "double")
    ship(spark)
    return demo.points(spark, sf_dir).select("point_idx", F.round(far("x", "y"), 6).alias("distance"))


def sql_scalars(spark, sf_dir):
    """The functions for SQL text: distances, an edge that a road's line crosses, and the projection."""
    sql_functions.register(spark)
    _lonlat(spark, sf_dir).join(demo.points(spark, sf_dir), "point_idx").createOrReplaceTempView("roadloom_places")
    return spark.sql("""SELECT point_idx, round(road_distance(x, y, 1000D, 1000D), 6) AS distance, round(road_point_edge(x, y, 500D, 500D, 900D, 500D), 6) AS to_edge,
        road_edges_meet(x, y, x + 300, y, 1000D, 800D, 1000D, 1200D) AS meets, round(utm_easting(lon, lat, 45), 4) AS east, round(utm_northing(lon, lat, 45), 4) AS north FROM roadloom_places""")


def nearest_road_sql(spark, sf_dir):
    """Nearest roads by one SQL statement."""
    rows = sql_functions.nearest(demo.points(spark, sf_dir), roads.edges(demo.roads(spark, sf_dir)), 50.0, 2.0 * demo.SIDE)
    return rows.select("point_idx", *_whole("road_uid"), *_six("dist_to_road"))


def columnar_points(spark, sf_dir):
    """Points written as a columnar layer and read again, geometry from its well-known binary."""
    path = _folder(spark)
    columnar.write(demo.points(spark, sf_dir), path, crs.utm(45), 400)
    held, system = columnar.read(spark, path)
    vertex = F.col("parts")[0][0]
    return geometry.from_wkb(held.select("point_idx", "wkb")).select("point_idx", vertex["x"].alias("x"), vertex["y"].alias("y"), F.lit(system.srid).cast("long").alias("srid"))


def columnar_roads_in_a_box(spark, sf_dir):
    """Roads whose boxes meet a window: only files that may hold some are opened."""
    path = _folder(spark)
    columnar.write(demo.roads(spark, sf_dir), path, crs.utm(45), 10)
    return columnar.read(spark, path, (500.0, 500.0, 900.0, 800.0))[0].select("road_uid", *(F.col(c).alias(c[4:]) for c in columnar.BOX))


def reprojected_points(spark, sf_dir):
    """The reprojection job: a layer in degrees is written in metres."""
    shapefile.register(spark)
    source, target = _target(spark, "degrees.shp"), _target(spark, "metres.shp")
    _lonlat(spark, sf_dir).select("point_idx", F.col("lon").alias("x"), F.col("lat").alias("y")).orderBy("point_idx").write.format("shapefile").option("crs", "EPSG:4326").mode("overwrite").save(source)
    if not analysis.reproject(spark, source, target):
        raise RuntimeError("nothing was written")
    held, _ = analysis.read_layer(spark, target)
    return held.select(*_whole("point_idx"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def observed_counts(spark, sf_dir):
    """The counts that a run observes while it materialises its tables."""
    points, adjacent = _associated(spark, sf_dir)
    pairs = analysis.observed(roads.counted(demo.roads(spark, sf_dir)), "pairs", pairs=F.sum("pairs"))[1]
    counts = analysis.observed(dbscan.cluster(points, adjacent, EPS, MIN_PTS), "counts", **summarize.observed_counts())[1]
    return spark.createDataFrame([(k, v) for k, v in (pairs | counts).items()], "what string, rows long")


def incremental_dbscan(spark, sf_dir):
    """Points that arrive in three batches; each computes again what it touches only."""
    points, adjacent = _associated(spark, sf_dir)
    state = ClusterState(spark, _folder(spark), adjacent, EPS, MIN_PTS)
    for n in range(3):
        state.update(points.where(F.col("point_idx") % 3 == n), n)
    return state.labels().select("point_idx", "core", "cluster")


def map_cells(spark, sf_dir):
    """Cells of one zoom level of the map."""
    rows = layers.pyramid(_degrees(labelled(spark, sf_dir))).where("zoom = 10")
    return rows.select(*_whole("cx", "cy"), "kind", "points", *_six("lat", "lon"), "first", "last")


def map_levels(spark, sf_dir):
    """Points and cells of each level: all of them hold all points."""
    rows = layers.pyramid(_degrees(labelled(spark, sf_dir)))
    return rows.groupBy(*_whole("zoom")).agg(F.sum("points").alias("points"), F.countDistinct("cx", "cy").alias("cells"))


def heat_points(spark, sf_dir):
    """The heat layer: every point, noise too. It has no labels, so nothing is clustered for it."""
    return layers.heat_layer(_degrees(demo.points(spark, sf_dir))).groupBy(*_six("lat", "lon")).agg(F.count(F.lit(1)).alias("points"))


def map_guards(spark, sf_dir):
    """What is drawn of points without labels, of none, of null labels, and of all: points by themselves, or more than a page holds in cells that tell how many."""
    rows = demo.points(spark, sf_dir).withColumn("cluster", F.when(F.col("point_idx") % 4 == 0, None).when(F.col("point_idx") % 4 == 1, -1).otherwise(1).cast("long"))
    cases = {"no labels": rows.drop("cluster"), "no points": rows.where("false"), "not a number": rows.withColumn("x", F.lit(float("nan"))), "all": rows}
    out = []
    for name, held in cases.items():
        data = html.map_data(held, crs.utm(45))
        out.append((name, data is not None, *html.drawn(data)))
    return spark.createDataFrame(out, "guard string, drawn boolean, points long, heat long")


def palette_rainbow(spark, sf_dir):
    return layers.palette(labelled(spark, sf_dir), "turbo").select("cluster", "position", "color")


def palette_fallback(spark, sf_dir):
    """Without the palette all clusters are of one colour."""
    return layers.palette(labelled(spark, sf_dir), "not there").select("cluster", "color")


def clustering_guards(spark, sf_dir):
    """No graph: all points are noise. No points: no rows. A graph without rows: points pair on their own road."""
    points = demo.points(spark, sf_dir).withColumn("road_uid", F.lit(1).cast("long"))
    none = spark.createDataFrame([], "uid_a long, uid_b long")
    counts = lambda rows, case: rows.agg(F.lit(case).alias("guard"), F.count(F.lit(1)).alias("points"), F.count_if(F.col("cluster") == -1).alias("noise"))
    one_road = dbscan.cluster(points, none, 1.0, MIN_PTS)
    return counts(dbscan.cluster(points, None, EPS, MIN_PTS), "no graph").union(counts(dbscan.cluster(points.where("false"), none, EPS, MIN_PTS), "no points")).union(counts(one_road, "empty graph"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        cluster_summary, point_clean, road_clean, road_audit, road_uid_dense, road_edges, road_intersections, road_intersections_bent,
        road_intersections_tol_compat, road_intersections_tol_effective, road_intersections_tol_buffer, road_adjacency, road_neighbour_lists, road_reach_1hop, isolated_roads,
        nearest_road, nearest_road_ties, association_counts, eps_pairs, constrained_pairs, unassociated_pairs, core_points, border_points,
        noise_points, core_components, constrained_dbscan, constrained_dbscan_snapped, plain_dbscan_contrast, cluster_sizes,
        cluster_centroids_distinct, cluster_hull_area, run_counts, map_center, cluster_palette_index, popup_text, palette_choice,
        hull_sizes_join, legend_labels, plot_groups, utm_forward, utm_roundtrip, point_distance, sentinel_coerce, wkb_roundtrip,
        shapefile_points, shapefile_lines, geopackage_roads, geopackage_points, summary_csv, summary_ordered, legend_ordered, failed_join, merged_uid,
        unassociated_counts, road_tooltips, palette_listed, centroid_popups, hull_tooltips, hull_tooltips_text, map_centre_degrees, crs_tests,
        utm_known_places, argument_checks, output_files, clustering_guards, point_distance_checked, sql_scalars, nearest_road_sql, columnar_points,
        columnar_roads_in_a_box, reprojected_points, observed_counts, incremental_dbscan, map_cells, map_levels, heat_points, map_guards, palette_rainbow, palette_fallback,
    )
}


def _points_sql(snap: int = 1) -> str:
    return f"""pts AS (SELECT idx AS point_idx, CAST(x - x % {snap} AS DOUBLE) AS x, CAST(y - y % {snap} AS DOUBLE) AS y FROM (
        SELECT CAST(c_custkey AS BIGINT) AS idx, (CAST(c_custkey AS BIGINT) * 7919 + CAST(c_nationkey AS BIGINT) * 131) % 2000 AS x,
            ((CAST(round(c_acctbal * 100) AS BIGINT) % 2000) + 2000) % 2000 AS y FROM customer))"""


_ROADS = """line AS (SELECT CAST(s_suppkey AS BIGINT) AS road_uid FROM supplier), ends AS (SELECT road_uid, road_uid % 2 = 0 AS even,
        CASE WHEN road_uid % 2 = 0 THEN (road_uid * 389) % 1600 ELSE (road_uid * 577) % 2000 END AS x1,
        CASE WHEN road_uid % 2 = 0 THEN (road_uid * 241) % 2000 ELSE (road_uid * 613) % 1600 END AS y1 FROM line),
    rds AS (SELECT road_uid, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x1 + CASE WHEN even THEN 400 ELSE 0 END AS DOUBLE) AS x2,
        CAST(y1 + CASE WHEN even THEN 0 ELSE 400 END AS DOUBLE) AS y2 FROM ends)"""
_BENT = _ROADS + """, bent AS (SELECT road_uid, x1, y1, x2, y2 FROM rds UNION ALL SELECT road_uid, x2, y2, x2 + 50, y2 + 50 FROM rds)"""


def _turn(a: str, x: str, y: str) -> str:
    return f"sign(({a}.x2 - {a}.x1) * ({y} - {a}.y1) - ({a}.y2 - {a}.y1) * ({x} - {a}.x1))"


def _pairs_sql(table: str = "rds") -> str:
    box = " AND ".join(f"least(a.{k}1, a.{k}2) <= greatest(b.{k}1, b.{k}2) AND least(b.{k}1, b.{k}2) <= greatest(a.{k}1, a.{k}2)" for k in "xy")
    cross = " AND ".join(f"{_turn(p, f'{q}.x1', f'{q}.y1')} * {_turn(p, f'{q}.x2', f'{q}.y2')} <= 0" for p, q in (("a", "b"), ("b", "a")))
    return f"pairs AS (SELECT DISTINCT a.road_uid AS uid_a, b.road_uid AS uid_b FROM {table} a JOIN {table} b ON a.road_uid < b.road_uid AND {box} AND {cross})"


_ADJ = "adj AS (SELECT uid_a, uid_b FROM pairs UNION SELECT uid_b, uid_a FROM pairs)"
_REACH = """reach AS (SELECT road_uid AS uid_p, road_uid AS uid_q FROM rds UNION SELECT uid_a, uid_b FROM adj
        UNION SELECT a.uid_a, b.uid_b FROM adj a JOIN adj b ON a.uid_b = b.uid_a)"""


def _near_sql(points: str = "pts") -> str:
    t = "greatest(0.0, least(1.0, ((p.x - r.x1) * (r.x2 - r.x1) + (p.y - r.y1) * (r.y2 - r.y1)) / ((r.x2 - r.x1) * (r.x2 - r.x1) + (r.y2 - r.y1) * (r.y2 - r.y1))))"
    return f"""cand AS (SELECT p.point_idx, p.x, p.y, r.road_uid, r.x1 + {t} * (r.x2 - r.x1) AS qx, r.y1 + {t} * (r.y2 - r.y1) AS qy FROM {points} p CROSS JOIN rds r),
    near AS (SELECT point_idx, x, y, road_uid, d2 FROM (SELECT *, (x - qx) * (x - qx) + (y - qy) * (y - qy) AS d2 FROM cand)
        QUALIFY row_number() OVER (PARTITION BY point_idx ORDER BY d2, road_uid) = 1)"""


_NEIGHBOURS = f"""nb AS (SELECT p.point_idx AS i, q.point_idx AS j FROM near p JOIN near q ON p.point_idx <> q.point_idx
        AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= {EPS * EPS} JOIN reach ON reach.uid_p = p.road_uid AND reach.uid_q = q.road_uid)"""
_LABELS = f"""core AS (SELECT i FROM nb GROUP BY i HAVING count(*) >= {MIN_PTS - 1}),
    link AS (SELECT nb.i, nb.j FROM nb JOIN core a ON nb.i = a.i JOIN core b ON nb.j = b.i),
    spread(i, j) AS (SELECT i, i FROM core UNION SELECT spread.i, link.j FROM spread JOIN link ON spread.j = link.i),
    root AS (SELECT i, min(j) AS root FROM spread GROUP BY i), numbered AS (SELECT i, dense_rank() OVER (ORDER BY root) AS cluster FROM root),
    border AS (SELECT nb.i, min(n.cluster) AS cluster FROM nb JOIN numbered n ON nb.j = n.i GROUP BY nb.i),
    lab AS (SELECT p.point_idx, p.x, p.y, p.road_uid, n.i IS NOT NULL AS core, CAST(coalesce(n.cluster, b.cluster, -1) AS BIGINT) AS cluster
        FROM near p LEFT JOIN numbered n ON p.point_idx = n.i LEFT JOIN border b ON p.point_idx = b.i)"""


def _associated_sql(snap: int = 1) -> str:
    return f"WITH RECURSIVE {_points_sql(snap)}, {_ROADS}, {_pairs_sql()}, {_ADJ}, {_REACH}, {_near_sql()}, {_NEIGHBOURS}"


def _labels_sql(snap: int = 1) -> str:
    return f"{_associated_sql(snap)}, {_LABELS}"


_HULL = """dist AS (SELECT DISTINCT cluster, x, y FROM lab WHERE cluster > 0),
    side AS (SELECT p.cluster, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM dist p JOIN dist q ON p.cluster = q.cluster AND (p.x <> q.x OR p.y <> q.y)),
    hull AS (SELECT s.* FROM side s WHERE NOT EXISTS (SELECT 1 FROM dist r WHERE r.cluster = s.cluster AND (
        (s.qx - s.px) * (r.y - s.py) - (s.qy - s.py) * (r.x - s.px) < 0 OR ((s.qx - s.px) * (r.y - s.py) - (s.qy - s.py) * (r.x - s.px) = 0
        AND ((r.x - s.px) * (s.qx - s.px) + (r.y - s.py) * (s.qy - s.py) < 0 OR (r.x - s.qx) * (s.px - s.qx) + (r.y - s.qy) * (s.py - s.qy) < 0))))),
    areas AS (SELECT cluster, sum(px * qy - qx * py) / 2 AS area FROM hull GROUP BY cluster HAVING sum(px * qy - qx * py) <> 0),
    mid AS (SELECT cluster, avg(x) AS x, avg(y) AS y FROM dist GROUP BY cluster), sized AS (SELECT cluster, count(*) AS size FROM lab WHERE cluster > 0 GROUP BY cluster)"""
_RAW = """raw AS (SELECT point_idx AS record_no, CASE WHEN point_idx % 17 = 0 OR point_idx % 19 = 0 THEN NULL ELSE x END AS x, y, point_idx % 23 = 0 AS other FROM pts)"""


def _utm_sql() -> str:
    """The projection in SQL, from the same coefficients."""
    zone = crs.utm(45)
    e, radius, _, alpha, _ = crs._constants(zone)
    north = " + ".join(["xi", *(f"({a!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    east = " + ".join(["eta", *(f"({a!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    return f"""WITH {_points_sql()}, s AS (SELECT point_idx, sin(radians(y * 0.04 - 40)) AS sn, radians(84 + x * 0.003 - 87.0) AS turn FROM pts),
    t AS (SELECT point_idx, turn, sinh(atanh(sn) - {e!r} * atanh({e!r} * sn)) AS t FROM s),
    k AS (SELECT point_idx, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM t)
    SELECT point_idx, round(500000.0 + {radius!r} * ({east}), 4) AS x, round({radius!r} * ({north}), 4) AS y FROM k"""


def _polynomial(coefficients: list[float]) -> str:
    text = "0.0::DOUBLE"
    for k in reversed(coefficients):
        text = f"({text} * s + {k!r}::DOUBLE)"
    return text


_PAIRS = f"WITH {_ROADS}, {_pairs_sql()}"
_GRAPH = f"{_PAIRS}, {_ADJ}"
SQL: dict[str, str] = {
    "cluster_summary": f"{_labels_sql(50)}, {_HULL} SELECT s.cluster AS Cluster_ID, s.size AS Size, round(m.x, 6) AS Centroid_X, round(m.y, 6) AS Centroid_Y, round(a.area, 6) AS Hull_Area FROM sized s JOIN mid m ON s.cluster = m.cluster LEFT JOIN areas a ON s.cluster = a.cluster",
    "point_clean": f"WITH {_points_sql()}, {_RAW} SELECT record_no, row_number() OVER (ORDER BY record_no) - 1 AS point_idx, x, y FROM raw WHERE NOT other AND x IS NOT NULL",
    "road_clean": f"WITH {_ROADS}, keyed AS (SELECT road_uid AS record_no, row_number() OVER (ORDER BY road_uid) - 1 AS road_uid FROM rds WHERE road_uid % 11 <> 0) SELECT record_no, road_uid, CAST(2 AS BIGINT) AS vertices FROM keyed WHERE record_no % 10 NOT IN (3, 7)",
    "road_audit": f"WITH {_ROADS} SELECT count(*) AS total, count(*) FILTER (road_uid % 10 = 3) AS invalid, count(*) FILTER (road_uid % 10 = 7) AS empty FROM rds",
    "road_uid_dense": f"WITH {_ROADS} SELECT road_uid AS record_no, row_number() OVER (ORDER BY road_uid) - 1 AS road_uid FROM rds WHERE road_uid % 11 <> 0",
    "road_edges": f"WITH {_BENT} SELECT road_uid, x1, y1, x2, y2 FROM bent",
    "road_intersections": f"{_PAIRS} SELECT uid_a, uid_b FROM pairs",
    "road_intersections_bent": f"WITH {_BENT}, {_pairs_sql('bent')} SELECT uid_a, uid_b FROM pairs",
    "road_intersections_tol_compat": f"{_PAIRS} SELECT uid_a, uid_b FROM pairs",
    "road_intersections_tol_effective": f"""WITH {_ROADS}, gaps AS (SELECT a.road_uid AS uid_a, b.road_uid AS uid_b, greatest(0, a.x1 - b.x2, b.x1 - a.x2) AS gx, greatest(0, a.y1 - b.y2, b.y1 - a.y2) AS gy
        FROM rds a JOIN rds b ON a.road_uid < b.road_uid) SELECT uid_a, uid_b FROM gaps WHERE gx * gx + gy * gy <= {TOLERANCE * TOLERANCE}""",
    # axis-parallel roads: the polygon's sum with a road is an octagon of gaps
    "road_intersections_tol_buffer": f"""WITH {_ROADS}, gaps AS (SELECT a.road_uid AS uid_a, b.road_uid AS uid_b, greatest(0, a.x1 - b.x2, b.x1 - a.x2) AS gx, greatest(0, a.y1 - b.y2, b.y1 - a.y2) AS gy
        FROM rds a JOIN rds b ON a.road_uid < b.road_uid) SELECT uid_a, uid_b FROM gaps WHERE greatest(gx + (sqrt(2) - 1) * gy, gy + (sqrt(2) - 1) * gx) <= {BUFFER}""",
    "road_adjacency": f"{_GRAPH} SELECT uid_a, uid_b FROM adj",
    "road_neighbour_lists": f"{_GRAPH} SELECT r.road_uid, coalesce(string_agg(CAST(a.uid_b AS VARCHAR), ',' ORDER BY a.uid_b), '') AS neighbours, count(a.uid_b) AS degree FROM rds r LEFT JOIN adj a ON r.road_uid = a.uid_a GROUP BY r.road_uid",
    "road_reach_1hop": f"{_GRAPH}, {_REACH} SELECT uid_p, uid_q FROM reach",
    "isolated_roads": f"{_GRAPH} SELECT road_uid FROM rds WHERE road_uid NOT IN (SELECT uid_a FROM adj)",
    "nearest_road": f"WITH {_points_sql()}, {_ROADS}, {_near_sql()} SELECT point_idx, road_uid, round(sqrt(d2), 6) AS dist_to_road FROM near",
    "nearest_road_ties": f"WITH {_ROADS}, tips AS (SELECT road_uid * 2 AS point_idx, x1 AS x, y1 AS y FROM rds UNION ALL SELECT road_uid * 2 + 1, x2, y2 FROM rds), {_near_sql('tips')} SELECT point_idx, road_uid, round(sqrt(d2), 6) AS dist_to_road FROM near",
    "association_counts": f"WITH {_points_sql()}, {_ROADS}, {_near_sql()} SELECT count(*) AS associated, CAST(0 AS BIGINT) AS unassociated FROM near",
    "eps_pairs": f"WITH {_points_sql()} SELECT p.point_idx AS i, q.point_idx AS j FROM pts p JOIN pts q ON p.point_idx < q.point_idx AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= {EPS * EPS}",
    "constrained_pairs": f"{_associated_sql()} SELECT i, j FROM nb WHERE i < j",
    "unassociated_pairs": f"WITH {_points_sql()}, {_ROADS}, {_near_sql()}, far AS (SELECT * FROM near WHERE sqrt(d2) > 100) SELECT p.point_idx AS i, q.point_idx AS j FROM far p JOIN far q ON p.point_idx < q.point_idx AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= {EPS * EPS}",
    "core_points": f"{_labels_sql()} SELECT i AS point_idx FROM core",
    "border_points": f"{_labels_sql()} SELECT point_idx, cluster FROM lab WHERE NOT core AND cluster > 0",
    "noise_points": f"{_labels_sql()} SELECT point_idx FROM lab WHERE cluster = -1",
    "core_components": f"{_labels_sql()} SELECT cluster, min(point_idx) AS first_core, count(*) AS cores FROM lab WHERE core GROUP BY cluster",
    "constrained_dbscan": f"{_labels_sql()} SELECT point_idx, cluster FROM lab",
    "constrained_dbscan_snapped": f"{_labels_sql(50)} SELECT point_idx, cluster FROM lab",
    "plain_dbscan_contrast": f"""WITH RECURSIVE {_points_sql()}, near AS (SELECT *, 0 AS road_uid FROM pts),
        nb AS (SELECT p.point_idx AS i, q.point_idx AS j FROM pts p JOIN pts q ON p.point_idx <> q.point_idx AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= {EPS * EPS}), {_LABELS} SELECT point_idx, cluster FROM lab""",
    "cluster_sizes": f"{_labels_sql()} SELECT cluster, count(*) AS size FROM lab WHERE cluster > 0 GROUP BY cluster",
    "cluster_centroids_distinct": f"{_labels_sql(50)}, {_HULL} SELECT cluster, round(x, 6) AS x, round(y, 6) AS y FROM mid",
    "cluster_hull_area": f"{_labels_sql(50)}, {_HULL} SELECT cluster, round(area, 6) AS area FROM areas",
    "run_counts": f"{_labels_sql()} SELECT count(*) AS points, count(DISTINCT CASE WHEN cluster > 0 THEN cluster END) AS clusters, count(*) FILTER (cluster = -1) AS noise, count(*) FILTER (cluster > 0) AS clustered, count(*) FILTER (cluster = 0) AS unclassified FROM lab",
    "map_center": f"WITH {_points_sql()} SELECT round(avg(y / 100), 6) AS lat, round(avg(x / 100), 6) AS lon FROM pts",
    "cluster_palette_index": f"{_labels_sql()}, c AS (SELECT DISTINCT cluster FROM lab WHERE cluster <> -1), n AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS position, count(*) OVER () AS n FROM c) SELECT cluster, position, round(position / greatest(1, n - 1), 6) AS share FROM n",
    "popup_text": f"""{_labels_sql()}, sized AS (SELECT cluster, count(*) AS size FROM lab WHERE cluster > 0 GROUP BY cluster), named AS (SELECT lab.*, size, CASE WHEN lab.cluster = -1 THEN 'Noise Points' ELSE 'Cluster ' || lab.cluster END AS group_name FROM lab LEFT JOIN sized ON lab.cluster = sized.cluster)
        SELECT point_idx, group_name, CAST(CASE WHEN cluster = -1 THEN 2 ELSE 4 END AS BIGINT) AS radius, '<b>' || group_name || printf('</b><br>Lat: %.6f<br>Lon: %.6f<br>Cluster ID: %d<br>', y / 100, x / 100, cluster)
        || CASE WHEN cluster = -1 THEN '' ELSE printf('Cluster Size: %d<br>', size) END || 'Road Segment UID: ' || road_uid || '<br>' AS popup FROM named""",
    "palette_choice": f"WITH {_points_sql()} SELECT DISTINCT point_idx % 30 AS clusters, CASE WHEN point_idx % 30 > 20 THEN 'turbo' WHEN point_idx % 30 > 10 THEN 'tab20' WHEN point_idx % 30 > 0 THEN 'tab10' ELSE 'viridis' END AS palette FROM pts",
    "hull_sizes_join": f"{_labels_sql(50)}, {_HULL} SELECT CAST(c AS BIGINT) AS cluster, coalesce(size, 0) AS size FROM range(1, 151) t(c) LEFT JOIN sized ON c = cluster",
    "legend_labels": f"{_labels_sql()} SELECT DISTINCT 'Cluster ' || cluster AS label FROM lab WHERE cluster >= 0",
    "plot_groups": f"WITH {_points_sql()} SELECT CAST(CASE WHEN point_idx % 5 = 0 THEN -2 ELSE point_idx % 4 - 1 END AS BIGINT) AS cluster_plot, count(*) AS points FROM pts GROUP BY 1",
    "utm_forward": _utm_sql(),
    "utm_roundtrip": f"WITH {_points_sql()} SELECT point_idx, round(84 + x * 0.003, 8) AS lon, round(y * 0.04 - 40, 8) AS lat FROM pts",
    "point_distance": f"WITH {_points_sql()} SELECT point_idx, round(sqrt((x - 1000) * (x - 1000) + (y - 1000) * (y - 1000)), 6) AS distance FROM pts",
    "sentinel_coerce": f"WITH {_points_sql()} SELECT point_idx, CAST(CASE WHEN point_idx % 3 = 1 THEN point_idx ELSE -999 END AS BIGINT) AS road_uid FROM pts",
    "wkb_roundtrip": f"WITH {_points_sql()} SELECT point_idx, 'Point' AS kind, x, y FROM pts",
    "shapefile_points": f"WITH {_points_sql()} SELECT row_number() OVER (ORDER BY point_idx) - 1 AS record_no, point_idx, 'Point' AS kind, x, y, 'né ' || point_idx AS name, CAST(32645 AS BIGINT) AS srid FROM pts",
    "shapefile_lines": f"WITH {_ROADS}, v AS (SELECT road_uid, 0 AS k, x1 AS x, y1 AS y FROM rds UNION ALL SELECT road_uid, 1, x2, y2 FROM rds UNION ALL SELECT road_uid, 2, x2 + 50, y2 + 50 FROM rds) SELECT road_uid, 'LineString' AS kind, road_uid / 8 AS width, CAST(k AS BIGINT) AS k, x, y FROM v",
    "geopackage_roads": f"WITH {_ROADS}, v AS (SELECT road_uid, 0 AS k, x1 AS x, y1 AS y FROM rds UNION ALL SELECT road_uid, 1, x2, y2 FROM rds) SELECT road_uid, CAST(k AS BIGINT) AS k, x, y FROM v",
    "geopackage_points": f"WITH {_points_sql()}, {_ROADS}, {_near_sql()} SELECT n.point_idx, n.road_uid, p.x, p.y, round(sqrt(n.d2), 6) AS dist_to_road FROM near n JOIN pts p ON n.point_idx = p.point_idx",
    "summary_csv": f"{_labels_sql(50)}, {_HULL} SELECT row_number() OVER (ORDER BY s.size DESC, s.cluster) - 1 AS position, s.cluster AS Cluster_ID, s.size AS Size, round(m.x, 6) AS Centroid_X, round(m.y, 6) AS Centroid_Y, round(a.area, 6) AS Hull_Area, 'cluster_summary_seg_intol0_eps60.0_mp5.csv' AS file FROM sized s JOIN mid m ON s.cluster = m.cluster LEFT JOIN areas a ON s.cluster = a.cluster",
    "summary_ordered": f"{_labels_sql(50)}, {_HULL} SELECT row_number() OVER (ORDER BY size DESC, cluster) - 1 AS position, cluster AS Cluster_ID, size AS Size FROM sized",
    "legend_ordered": f"{_labels_sql()}, c AS (SELECT DISTINCT cluster FROM lab WHERE cluster >= 0) SELECT 'Cluster ' || cluster AS label, row_number() OVER (ORDER BY cluster) - 1 AS position FROM c",
    "failed_join": f"WITH {_points_sql()} SELECT point_idx, CAST(-999 AS BIGINT) AS road_uid, true AS no_distance FROM pts",
    "merged_uid": f"WITH {_points_sql()} SELECT point_idx, point_idx % 3 AS road_uid FROM pts UNION ALL SELECT -point_idx, NULL FROM pts",
    "unassociated_counts": f"WITH {_points_sql()} SELECT count(*) FILTER (point_idx % 5 <> 0 AND point_idx % 3 <> 0) AS associated, count(*) FILTER (point_idx % 5 = 0 OR point_idx % 3 = 0) AS unassociated FROM pts",
    "road_tooltips": f"WITH {_ROADS} SELECT road_uid, 'name: road ' || road_uid || '<br>lanes: ' || CASE WHEN road_uid % 4 > 0 THEN CAST(road_uid % 4 AS VARCHAR) ELSE '' END AS tooltip, 'MultiLineString' AS shape FROM rds",
    # The ten colours of a public palette.
    "palette_listed": f"{_labels_sql()}, c AS (SELECT DISTINCT cluster FROM lab WHERE cluster <> -1), n AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS position FROM c) SELECT cluster, position, ['#1f77b4', '#ff7f0e', '#2ca02c', '#d62728', '#9467bd', '#8c564b', '#e377c2', '#7f7f7f', '#bcbd22', '#17becf'][position % 10 + 1] AS color FROM n",
    "centroid_popups": f"{_labels_sql(50)}, {_HULL} SELECT s.cluster, s.size, 'Centroid Cluster ' || s.cluster || ' (Size: ' || s.size || ')' AS popup FROM sized s JOIN mid m ON s.cluster = m.cluster",
    "hull_tooltips": f"{_labels_sql(50)}, {_HULL} SELECT a.cluster, s.size, 'Cluster ID: ' || a.cluster || '<br># Points: ' || s.size AS tooltip FROM areas a JOIN sized s ON a.cluster = s.cluster",
    "hull_tooltips_text": f"{_labels_sql(50)}, {_HULL} SELECT cluster, 'Cluster ID: ' || cluster || '<br>Size Info: about ' || cluster AS tooltip FROM areas",
    "map_centre_degrees": f"WITH {_points_sql()} SELECT round(avg(x * 0), 9) AS lat, round(avg(x * 0 + 87), 9) AS lon FROM pts",
    "crs_tests": f"""WITH {_points_sql()}, zones AS (SELECT DISTINCT point_idx % 60 + 1 AS zone FROM pts)
        SELECT 'EPSG:' || (base + zone) AS name, true AS projected, 'metre' AS unit, 'E' AS axis, base + zone AS srid, base + zone = 32645 AS same FROM zones, (VALUES (32600), (32700)) b(base)
        UNION ALL SELECT 'EPSG:4326', false, 'degree', 'Lon', 4326, false""",
    # The meridian's arc of the public ellipsoid from the equator to 45 degrees is 4984944.378 m; the scale is 0.9996.
    "utm_known_places": f"WITH {_points_sql()} SELECT point_idx, CAST(500000 AS DOUBLE) AS easting, round(CAST((point_idx % 3 - 1) * 0.9996 * 4984944.378 AS DOUBLE), 2) AS northing FROM pts",
    "argument_checks": f"""WITH {_points_sql()}, c AS (SELECT DISTINCT x % 3 - 1 AS eps, point_idx % 5 AS min_pts, y % 3 - 1 AS tolerance FROM pts)
        SELECT eps, min_pts, tolerance, CASE WHEN eps > 0 AND min_pts >= 2 AND tolerance >= 0 THEN 'taken' ELSE 'refused' END AS outcome FROM c""",
    "output_files": """WITH p AS (SELECT DISTINCT CAST(s_suppkey AS BIGINT) % 7 + 2 AS min_pts FROM supplier)
        SELECT min_pts, kind, 'out/' || base || '_seg_intol0_eps' || (min_pts * 30) || '.0_mp' || min_pts || '.' || tail AS path FROM p, (VALUES ('summary', 'cluster_summary', 'csv'), ('map', 'cluster_map', 'html'), ('plot', 'static_cluster_map', 'png'), ('roads', 'roads_projected', 'gpkg'), ('points', 'points_associated', 'gpkg')) t(kind, base, tail)""",
    "point_distance_checked": f"WITH {_points_sql()} SELECT point_idx, round(sqrt((x - 1000) * (x - 1000) + (y - 1000) * (y - 1000)), 6) AS distance FROM pts",
    "sql_scalars": f"""WITH u AS ({_utm_sql()}), {_points_sql()} SELECT point_idx, round(sqrt((pts.x - 1000) * (pts.x - 1000) + (pts.y - 1000) * (pts.y - 1000)), 6) AS distance,
        round(sqrt(power(greatest(500 - pts.x, 0, pts.x - 900), 2) + power(pts.y - 500, 2)), 6) AS to_edge, pts.x <= 1000 AND pts.x + 300 >= 1000 AND pts.y BETWEEN 800 AND 1200 AS meets, u.x AS east, u.y AS north FROM pts JOIN u USING (point_idx)""",
    "nearest_road_sql": f"WITH {_points_sql()}, {_ROADS}, {_near_sql()} SELECT point_idx, road_uid, round(sqrt(d2), 6) AS dist_to_road FROM near",
    "columnar_points": f"WITH {_points_sql()} SELECT point_idx, x, y, CAST(32645 AS BIGINT) AS srid FROM pts",
    "columnar_roads_in_a_box": f"WITH {_ROADS} SELECT road_uid, x1, y1, x2, y2 FROM rds WHERE x1 <= 900 AND x2 >= 500 AND y1 <= 800 AND y2 >= 500",
    "reprojected_points": _utm_sql(),
    "observed_counts": f"""{_labels_sql()} SELECT 'pairs' AS what, count(*) AS rows FROM pairs UNION ALL SELECT 'points', count(*) FROM lab UNION ALL SELECT 'clusters', count(DISTINCT cluster) FILTER (cluster > 0) FROM lab
        UNION ALL SELECT 'noise', count(*) FILTER (cluster = -1) FROM lab UNION ALL SELECT 'clustered', count(*) FILTER (cluster > 0) FROM lab UNION ALL SELECT 'unclassified', 0""",
    "incremental_dbscan": f"{_labels_sql()} SELECT point_idx, core, cluster FROM lab",
    "map_cells": f"""{_labels_sql()}, m AS (SELECT floor((x / 100 + 180) / 360 * 8192) AS cx, floor((0.5 - asinh(tan(radians(y / 100))) / (2 * pi())) * 8192) AS cy, x / 100 AS lon, y / 100 AS lat, cluster FROM lab)
        SELECT CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, CASE WHEN cluster = -1 THEN 'noise' ELSE 'cluster' END AS kind, count(*) AS points, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, min(cluster) AS first, max(cluster) AS last FROM m GROUP BY 1, 2, 3""",
    "map_levels": f"""WITH {_points_sql()}, m AS (SELECT (x / 100 + 180) / 360 AS u, 0.5 - asinh(tan(radians(y / 100))) / (2 * pi()) AS v FROM pts), z AS (SELECT CAST(range AS BIGINT) AS zoom, power(2, range) * 8 AS side FROM range(2, 17))
        SELECT zoom, count(*) AS points, count(DISTINCT floor(u * side) * 1048576 + floor(v * side)) AS cells FROM m, z GROUP BY zoom""",
    "heat_points": f"WITH {_points_sql()} SELECT round(y / 100, 6) AS lat, round(x / 100, 6) AS lon, count(*) AS points FROM pts GROUP BY 1, 2",
    "map_guards": f"""WITH {_points_sql()} SELECT 'all' AS guard, true AS drawn, count(*) FILTER (point_idx % 4 <> 0) AS points, count(*) AS heat FROM pts
        UNION ALL SELECT unnest(['no labels', 'no points', 'not a number']), false, 0, 0""",
    "palette_rainbow": f"""{_labels_sql()}, c AS (SELECT DISTINCT cluster FROM lab WHERE cluster <> -1), n AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS position FROM c),
        t AS (SELECT cluster, position, CAST(position AS DOUBLE) / greatest(1, (SELECT count(*) FROM n) - 1) AS s FROM n) SELECT cluster, position, '#' || {" || ".join(f"lower(printf('%02x', CAST(floor(least(1.0, greatest(0.0, {_polynomial(c)})) * 255 + 0.5) AS INTEGER)))" for c in layers.TURBO.values())} AS color FROM t""",
    "palette_fallback": f"{_labels_sql()} SELECT DISTINCT cluster, 'blue' AS color FROM lab WHERE cluster <> -1",
    "clustering_guards": f"""WITH {_points_sql()}, near AS (SELECT p.point_idx, count(*) - 1 AS n FROM pts p JOIN pts q ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 1 GROUP BY 1),
        core AS (SELECT p.* FROM pts p JOIN near ON p.point_idx = near.point_idx WHERE n >= {MIN_PTS - 1}),
        reached AS (SELECT DISTINCT p.point_idx FROM pts p JOIN core c ON (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) <= 1)
        SELECT 'no graph' AS guard, count(*) AS points, count(*) AS noise FROM pts UNION ALL SELECT 'no points', 0, 0
        UNION ALL SELECT 'empty graph', count(*), count(*) - (SELECT count(*) FROM reached) FROM pts""",
}
