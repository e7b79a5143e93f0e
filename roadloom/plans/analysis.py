"""The whole analysis: from two layers to labelled points, summary, layers and maps; and the reprojection job."""

from __future__ import annotations

import csv
import logging
import os
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geometry
from roadloom.functions.crs import Crs, parse, reproject_lines, reproject_points, to_wkt
from roadloom.operators import associate, clean, dbscan, roads, summarize
from roadloom.render import html, static
from roadloom.session import cut
from roadloom.sources import columnar, geopackage, shapefile

LOG = logging.getLogger(__name__)
SUMMARY = ["Cluster_ID", "Size", "Centroid_X", "Centroid_Y", "Hull_Area"]


class AnalysisError(RuntimeError):
    """The analysis can't go on."""


@dataclass
class Result:
    points: DataFrame
    roads: DataFrame
    adjacent: DataFrame
    summary: DataFrame
    counts: dict[str, int]
    files: dict[str, str]


def check_arguments(points, lines, eps, min_pts, tolerance) -> None:
    """Raised before any work is done."""
    for name in (points, lines):
        if not isinstance(name, str):
            raise TypeError("input names must be strings")
    dbscan.check_arguments(eps, min_pts)
    if isinstance(tolerance, bool) or not isinstance(tolerance, (int, float)) or tolerance < 0:
        raise ValueError("the tolerance must not be negative")


def output_names(folder: str, eps, min_pts, tolerance) -> dict[str, str]:
    suffix = f"seg_intol{tolerance}_eps{eps}_mp{min_pts}"
    names = {"summary": "cluster_summary_{}.csv", "map": "cluster_map_{}.html", "plot": "static_cluster_map_{}.png", "roads": "roads_projected_{}.gpkg", "points": "points_associated_{}.gpkg"}
    return {k: os.path.join(folder, v.format(suffix)) for k, v in names.items()}


def read_layer(spark: SparkSession, path: str) -> tuple[DataFrame, Crs]:
    """A shapefile with its coordinate reference system."""
    if not isinstance(path, str):
        raise TypeError("input names must be strings")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    shapefile.register(spark)
    crs = shapefile.read_crs(path)
    if crs is None:
        raise AnalysisError(f"{path} has no coordinate reference system")
    return spark.read.format("shapefile").load(path), crs


def prepare(points: DataFrame, points_crs: Crs, lines: DataFrame, lines_crs: Crs, on_invalid: str = "fail") -> tuple[DataFrame, DataFrame]:
    """Cleaned points and roads in the points' system. Roads are moved before they are intersected."""
    if not points_crs.projected:
        raise AnalysisError("points must be in a projected system")
    clean_points = cut(clean.clean_points(points))
    if clean_points.isEmpty():
        raise AnalysisError("no valid points")
    moved = reproject_lines(clean.clean_roads(lines, on_invalid=on_invalid), lines_crs, points_crs)
    kept = cut(moved.where(geometry.valid_line(F.col("parts"))))
    if kept.isEmpty():
        raise AnalysisError("no valid roads")
    return clean_points, kept


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` materialised, and counts that were taken while it was: no job of their own."""
    held = Observation(name)
    out = cut(df.observe(held, *(c.alias(k) for k, c in counts.items())))
    return out, {k: v or 0 for k, v in held.get.items()}


def write_summary(path: str, table: DataFrame) -> None:
    """The summary as one CSV file, largest clusters first; numbers as Python writes them, nulls empty."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(SUMMARY)
        for r in summarize.ordered(table).toLocalIterator():
            out.writerow(["" if r[c] is None else repr(r[c]) for c in SUMMARY])


def analyze(
    spark: SparkSession, points_path: str, lines_path: str, eps: float = 150.0, min_pts: int = 5, tolerance: float = 0, folder: str = ".",
    heat: bool = True, plot: bool = True, tolerance_mode: str = "compat", on_invalid: str = "fail", layer_format: str = "geopackage",
) -> Result:
    """Cluster the points of one shapefile on the roads of another and write all results to ``folder``.

    Layers are GeoPackages, one file each, or with ``layer_format="columnar"`` folders that all executors write (:mod:`roadloom.sources.columnar`).
    """
    if layer_format not in ("geopackage", "columnar"):
        raise ValueError("layer_format is 'geopackage' or 'columnar'")
    check_arguments(points_path, lines_path, eps, min_pts, tolerance)
    os.makedirs(folder, exist_ok=True)
    files = output_names(folder, eps, min_pts, tolerance)
    raw_points, crs = read_layer(spark, points_path)
    raw_lines, lines_crs = read_layer(spark, lines_path)
    points, lines = prepare(raw_points, crs, raw_lines, lines_crs, on_invalid)
    geopackage.register(spark)
    if layer_format == "columnar":
        files |= {k: f"{os.path.abspath(files[k]).removesuffix('.gpkg')}.layer" for k in ("roads", "points")}

    def save(rows: DataFrame, path: str) -> None:
        if layer_format == "columnar":
            columnar.write(rows, path, crs)
        else:
            srid = {"crs": f"EPSG:{crs.srid}"} if crs.srid else {}
            rows.write.format("geopackage").options(**srid).mode("overwrite").save(path)

    try:
        save(lines.drop("kind", "record_no"), files["roads"])
    except Exception as e:  # a missing road layer doesn't change the analysis
        LOG.warning("roads could not be saved: %s", e)
    pairs, crossings = observed(roads.intersections(lines, tolerance, tolerance_mode), "intersections", pairs=F.count(F.lit(1)))
    LOG.info("intersecting pairs of roads: %d", crossings["pairs"])
    adjacent = cut(roads.adjacency(pairs))
    none = F.col("road_uid") == associate.NONE
    found, told = observed(associate.associate(points, lines), "association", associated=F.count_if(~none), unassociated=F.count_if(none))
    LOG.info("associated %s", told)
    attributes = [c for c in raw_points.columns if c not in ("record_no", "kind", "x", "y")]
    saved = found.where(geometry.valid_point(F.col("x"), F.col("y"))).select("x", "y", *attributes, "road_uid", "dist_to_road")
    save(saved, files["points"])
    labelled, counts = observed(dbscan.cluster(found, adjacent, eps, min_pts), "labels", **summarize.observed_counts())
    LOG.info("labelled %s", counts)
    if counts["unclassified"]:
        LOG.warning("%d points are unclassified", counts["unclassified"])
    table = cut(summarize.summary(labelled))
    if counts["clusters"]:
        write_summary(files["summary"], table)
    hulls, centroids = summarize.hulls(labelled), summarize.centroids(labelled)
    html.write_map(files["map"], html.map_data(labelled, crs, lines.drop("kind", "record_no"), centroids, hulls, heat))
    if plot:
        static.write_plot(files["plot"], static.plot_data(labelled, crs, lines, crs))
    return Result(labelled, lines, adjacent, table, counts, {k: v for k, v in files.items() if os.path.exists(v)})


def reproject(spark: SparkSession, source_path: str, target_path: str, target: str = "EPSG:32645") -> bool:
    """Write a layer in another system; False, and nothing written, if it is in that system already."""
    layer, crs = read_layer(spark, source_path)
    to = parse(target)
    if crs == to:
        LOG.info("already in the target system")
        return False
    moved = reproject_points(layer, crs, to) if "x" in layer.columns else reproject_lines(layer, crs, to)
    moved.orderBy("record_no").write.format("shapefile").option("crs", to_wkt(to)).mode("overwrite").save(target_path)
    return True


def main(args: list[str] | None = None) -> int:
    """``python -m roadloom.plans.analysis POINTS.shp ROADS.shp FOLDER [EPS MIN_PTS TOLERANCE]``"""
    args = sys.argv[1:] if args is None else args
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    if len(args) not in (3, 6):
        print(main.__doc__)
        return 1
    missing = [p for p in args[:2] if not os.path.exists(p)]
    if missing:
        print("missing: " + ", ".join(missing))
        return 1
    number = lambda s: int(s) if s.lstrip("-").isdigit() else float(s)
    eps, min_pts, tolerance = map(number, args[3:] or ("150.0", "5", "0"))
    spark = SparkSession.builder.appName("roadloom").getOrCreate()
    try:
        result = analyze(spark, args[0], args[1], eps, min_pts, tolerance, args[2])
    except (AnalysisError, clean.LayerError) as e:
        print(f"stopped: {e}")
        return 1
    print(f"{result.counts['clusters']} clusters, {result.counts['noise']} noise points of {result.counts['points']}; review the number of intersections ({result.adjacent.count() // 2}) and {result.files.get('summary', 'the summary')}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
