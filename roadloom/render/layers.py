"""The data of each map layer as a DataFrame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions.crs import WGS84, Crs, transform_vertices, with_transformed
from roadloom.operators.keys import dense_index
from roadloom.operators.summarize import sizes
from roadloom.session import cut

# Coefficients of the polynomial for the rainbow palette, from the constant term upwards.
TURBO = {
    "red": [0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943],
    "green": [0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604],
    "blue": [0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973],
}
# Ten categorical colours, and the lighter ones between them.
TAB10 = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf"]
TAB20_LIGHT = ["#aec7e8", "#ffbb78", "#98df8a", "#ff9896", "#c5b0d5", "#c49c94", "#f7b6d2", "#c7c7c7", "#dbdb8d", "#9edae5"]
NOISE_COLOUR, FALLBACK_COLOUR, NO_PALETTE_COLOUR = "grey", "black", "blue"
PALETTES = ("turbo", "tab10", "tab20")
#: A cell of the pyramid is so many pixels wide at its zoom level; its finest and coarsest level.
CELL_PIXELS, TILE_PIXELS, LOWEST, HIGHEST = 32, 256, 2, 16
MERCATOR_END = 85.0511287798066


def geographic(points: DataFrame, crs: Crs) -> DataFrame:
    """``points`` with ``lon`` and ``lat``."""
    return with_transformed(points, crs, WGS84, "lon", "lat")


def map_center(points: DataFrame) -> DataFrame:
    """One row: the mean ``lat`` and ``lon`` of all points, noise too."""
    return points.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def palette_choice(clusters: Column) -> Column:
    """The palette of the static map for a number of clusters."""
    return F.when(clusters > 20, "turbo").when(clusters > 10, "tab20").when(clusters > 0, "tab10").otherwise("viridis")


def turbo_hex(share: Column) -> Column:
    def channel(c: list[float]) -> Column:
        value = F.lit(0.0)
        for k in reversed(c):
            value = value * share + F.lit(k)
        return F.lpad(F.lower(F.hex(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)) * 255).cast("int"))), 2, "0")

    return F.concat(F.lit("#"), *(channel(c) for c in TURBO.values()))


def listed_hex(position: Column, colours: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, colours)), (position % len(colours) + 1).cast("int"))


def palette_index(labelled: DataFrame) -> DataFrame:
    """``cluster, position, share``: a cluster's place by number, and that place divided by ``max(1, n - 1)``."""
    placed = dense_index(labelled.where(F.col("cluster").isNotNull() & (F.col("cluster") != -1)).select("cluster").distinct(), ["cluster"], "position")
    last = max(1, placed.count() - 1)
    return placed.select("cluster", F.col("position").cast("bigint").alias("position"), (F.col("position") / last).alias("share"))


def palette(labelled: DataFrame, name: str = "turbo") -> DataFrame:
    """``cluster, position, share, color``; all blue if there is no palette of that name."""
    index = palette_index(labelled)
    if name not in PALETTES:
        return index.withColumn("color", F.lit(NO_PALETTE_COLOUR))
    mixed = [c for pair in zip(TAB10, TAB20_LIGHT) for c in pair]
    color = turbo_hex(F.col("share")) if name == "turbo" else listed_hex(F.col("position"), TAB10 if name == "tab10" else mixed)
    return index.withColumn("color", color)


def with_size(table: DataFrame, labelled: DataFrame) -> DataFrame:
    """``table`` with each cluster's number of points, 0 where there are none."""
    return table.join(sizes(labelled), "cluster", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))


def group_name(cluster: Column) -> Column:
    return F.when(cluster == -1, "Noise Points").otherwise(F.concat(F.lit("Cluster "), cluster.cast("string")))


def point_layer(points: DataFrame) -> DataFrame:
    """Points with ``lat, lon, cluster`` (and ``road_uid``) with group, radius, colour and popup. Null clusters are left out."""
    c = F.col("cluster")
    rows = points.where(c.isNotNull()).withColumn("cluster", c.cast("bigint"))
    rows = rows.join(palette(rows).select("cluster", "color"), "cluster", "left")
    counted = rows.where(c != -1).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    rows = rows.join(counted, "cluster", "left")
    name = group_name(c)
    text = [F.concat(F.lit("<b>"), name, F.format_string("</b><br>Lat: %.6f<br>Lon: %.6f<br>Cluster ID: %d<br>", "lat", "lon", "cluster"))]
    text.append(F.when(c != -1, F.format_string("Cluster Size: %d<br>", "size")).otherwise(""))
    if "road_uid" in points.columns:
        uid = F.when(F.col("road_uid").isNull() | (F.col("road_uid") == -999), "N/A").otherwise(F.col("road_uid").cast("bigint").cast("string"))
        text.append(F.concat(F.lit("Road Segment UID: "), uid, F.lit("<br>")))
    color = F.when(c == -1, NOISE_COLOUR).otherwise(F.coalesce("color", F.lit(FALLBACK_COLOUR)))
    return rows.withColumns({"group_name": name, "shown": c != -1, "radius": F.when(c == -1, 2).otherwise(4), "color": color, "popup": F.concat(*text)})


def heat_layer(points: DataFrame) -> DataFrame:
    """``lat, lon`` of all points, noise and unlabelled ones too."""
    return points.select("lat", "lon")


def pyramid(points: DataFrame, low: int = LOWEST, high: int = HIGHEST) -> DataFrame:
    """Points (``lat, lon, cluster``) gathered into square cells of the map, once for each zoom level.

    ``zoom, cx, cy, kind`` (cluster, noise or none), ``points``, the mean ``lat, lon`` of a cell's points and its least and greatest
    ``cluster``. Every level holds all points with coordinates. The finest level is an aggregation of the points, and the others one of its cells.
    """
    c = F.col("cluster")
    kind = F.when(c.isNull(), "none").when(c == -1, "noise").otherwise("cluster")
    side = float(TILE_PIXELS // CELL_PIXELS << high)
    lat = F.radians(F.least(F.greatest(F.col("lat"), F.lit(-MERCATOR_END)), F.lit(MERCATOR_END)))
    within = lambda v: F.least(F.greatest(F.floor(v * side), F.lit(0)), F.lit(int(side) - 1)).cast("long")
    held = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        within((F.col("lon") + 180) / 360).alias("cx"), within(0.5 - F.asinh(F.tan(lat)) / (2 * math.pi)).alias("cy"), kind.alias("kind"), "lat", "lon", c.cast("long").alias("cluster")
    )
    finest = held.groupBy("cx", "cy", "kind").agg(F.count(F.lit(1)).alias("points"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.min("cluster").alias("first"), F.max("cluster").alias("last"))
    every = cut(finest).withColumn("zoom", F.explode(F.sequence(F.lit(low), F.lit(high))))
    up = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.lit(high) - F.col("zoom"))).cast("long")
    sums = every.groupBy("zoom", up("cx").alias("cx"), up("cy").alias("cy"), "kind").agg(F.sum("points").alias("points"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.min("first").alias("first"), F.max("last").alias("last"))
    return sums.withColumns({"lat": F.col("lat") / F.col("points"), "lon": F.col("lon") / F.col("points")})


def cell_layer(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    """Cells of :func:`pyramid` that hold labelled points, with colour (a cluster's own, where a cell holds one only) and popup."""
    colours = palette(labelled).select(F.col("cluster").alias("first"), "color")
    rows = cells.where("kind <> 'none'").join(colours, "first", "left")
    color = F.when(F.col("kind") == "noise", NOISE_COLOUR).when(F.col("first") == F.col("last"), F.coalesce("color", F.lit(FALLBACK_COLOUR))).otherwise(FALLBACK_COLOUR)
    name = F.when(F.col("kind") == "noise", "Noise Points").when(F.col("first") == F.col("last"), group_name(F.col("first"))).otherwise(F.format_string("Clusters %d to %d", "first", "last"))
    return rows.withColumns({"color": color, "popup": F.format_string("<b>%s</b><br>Points: %d", name, F.col("points"))})


def centroid_layer(centroids: DataFrame, labelled: DataFrame) -> DataFrame:
    """Centroids (``cluster`` and coordinates) with size and popup."""
    rows = centroids if "size" in centroids.columns else with_size(centroids, labelled)
    return rows.withColumn("popup", F.format_string("Centroid Cluster %d (Size: %d)", "cluster", "size"))


def hull_layer(hulls: DataFrame, labelled: DataFrame) -> DataFrame:
    """Hulls with size, fill colour and tooltip; the tooltip names a size that isn't a number otherwise."""
    rows = hulls if "size" in hulls.columns else with_size(hulls, labelled)
    rows = rows.join(palette(labelled).select("cluster", "color"), "cluster", "left").withColumn("color", F.coalesce("color", F.lit(FALLBACK_COLOUR)))
    title = "# Points:" if isinstance(rows.schema["size"].dataType, T.NumericType) else "Size Info:"
    return rows.withColumn("tooltip", F.concat(F.lit("Cluster ID: "), F.col("cluster").cast("string"), F.lit(f"<br>{title} "), F.col("size").cast("string")))


def tooltip_fields(df: DataFrame) -> list[str]:
    """Attributes of a road layer that its tooltip tells."""
    return [c for c in df.columns if c not in ("geometry", "parts", "wkb", "kind", "road_uid")]


def road_layer(roads: DataFrame, crs: Crs) -> DataFrame:
    """``geojson, tooltip`` of each road, in degrees."""
    coordinates = F.transform("parts", lambda p: F.transform(transform_vertices(p, crs, WGS84), lambda v: F.array(v["x"], v["y"])))
    shape = F.struct(F.lit("MultiLineString").alias("type"), coordinates.alias("coordinates"))
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in tooltip_fields(roads)]
    return roads.select("road_uid", F.to_json(shape).alias("geojson"), (F.concat_ws("<br>", *lines) if lines else F.lit("")).alias("tooltip"))


def plot_cluster(labelled: DataFrame) -> DataFrame:
    """``cluster_plot``: the label as a whole number, -2 for what isn't one."""
    return labelled.withColumn("cluster_plot", F.coalesce(F.col("cluster").cast("string").try_cast("double").try_cast("bigint"), F.lit(-2).cast("bigint")))


def legend(labelled: DataFrame) -> DataFrame:
    """``label, color`` of the static map's legend entries for clusters, in order."""
    plotted = plot_cluster(labelled).where("cluster_plot >= 0").select(F.col("cluster_plot").alias("cluster"))
    n = plotted.distinct().count()
    name = "turbo" if n > 20 else "tab20" if n > 10 else "tab10"
    return palette(plotted, name).orderBy("cluster").select(F.concat(F.lit("Cluster "), F.col("cluster").cast("string")).alias("label"), "color")
