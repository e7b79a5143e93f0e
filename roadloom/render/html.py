"""An interactive map as one HTML page. Rows reach the driver in chunks, at most ``LIMIT`` a layer.

More points than that are drawn as cells of the pyramid (:func:`roadloom.render.layers.pyramid`): as many of its levels, from the coarsest on, as
the page may hold, each of which covers every point. The page shows the level that fits the zoom; the heat layer takes the finest.
"""

from __future__ import annotations

import html
import json
import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.crs import WGS84, Crs, transform_vertices
from roadloom.functions.geometry import valid_point
from roadloom.render import layers
from roadloom.session import cut

LOG = logging.getLogger(__name__)
#: A page is made for one reader: of more points it gets cells; another layer with more rows is left out with a warning.
LIMIT = 200_000

# Tile layers (name, address, attribution, shown).
TILES = [
    ("OpenStreetMap", "https://tile.openstreetmap.org/{z}/{x}/{y}.png", "&copy; OpenStreetMap contributors", True),
    ("CartoDB Positron", "https://{s}.basemaps.cartocdn.com/light_all/{z}/{x}/{y}.png", "&copy; OpenStreetMap contributors, &copy; CARTO", False),
    ("CartoDB Dark", "https://{s}.basemaps.cartocdn.com/dark_all/{z}/{x}/{y}.png", "&copy; OpenStreetMap contributors, &copy; CARTO", False),
]
PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>%(title)s</title>
<link rel="stylesheet" href="https://unpkg.com/leaflet@1.9.4/dist/leaflet.css">
<script src="https://unpkg.com/leaflet@1.9.4/dist/leaflet.js"></script>
<script src="https://unpkg.com/leaflet.heat@0.2.0/dist/leaflet-heat.js"></script>
<style>html, body, #map { height: 100%%; margin: 0 }</style></head>
<body><div id="map"></div><script>
const data = %(data)s;
const map = L.map("map").setView(data.center, 12), bases = {}, overlays = {};
for (const [name, url, attribution, shown] of data.tiles) { bases[name] = L.tileLayer(url, {attribution}); if (shown) bases[name].addTo(map); }
const group = (name, shown) => { const g = L.layerGroup(); overlays[name] = g; if (shown) g.addTo(map); return g; };
if (data.roads) { const g = group("Road Network", true); for (const [shape, tip] of data.roads) { const l = L.geoJSON(shape, {style: {color: "gray", weight: 1.5, opacity: 0.7}}); if (tip) l.bindTooltip(tip); l.addTo(g); } }
for (const [name, shown, points] of data.groups) { const g = group(name, shown); for (const [lat, lon, radius, color, popup] of points) L.circleMarker([lat, lon], {radius, color, fill: true, fillColor: color, fillOpacity: 0.7}).bindPopup(popup, {maxWidth: 350}).addTo(g); }
if (data.cells) { const kinds = {cluster: group("Clustered Points", true), noise: group("Noise Points", false)}; const levels = Object.keys(data.cells).map(Number);
  const draw = () => { const fit = levels.filter(z => z <= map.getZoom()); const at = fit.length ? Math.max(...fit) : Math.min(...levels); for (const g of Object.values(kinds)) g.clearLayers(); for (const [lat, lon, kind, color, popup, points] of data.cells[at]) L.circleMarker([lat, lon], {radius: Math.min(16, 3 + Math.log2(points)), color, fill: true, fillColor: color, fillOpacity: 0.7}).bindPopup(popup).addTo(kinds[kind]); };
  map.on("zoomend", draw); draw(); }
if (data.centroids) { const g = group("Cluster Centroids", false); for (const [lat, lon, popup] of data.centroids) L.marker([lat, lon]).bindPopup(popup).addTo(g); }
if (data.hulls) { const g = group("Cluster Convex Hulls", false); for (const [ring, color, tip] of data.hulls) L.polygon(ring, {color: "black", weight: 1, fillColor: color, fillOpacity: 0.4}).bindTooltip(tip).addTo(g); }
if (data.heat) overlays["Heatmap"] = L.heatLayer(data.heat);
L.control.scale({position: "bottomleft", metric: true, imperial: true}).addTo(map);
L.control.layers(bases, overlays, {collapsed: false}).addTo(map);
</script></body></html>
"""


def _rows(df: DataFrame, what: str) -> list | None:
    """The rows of a layer; None if there are too many or the layer fails."""
    try:
        if df.limit(LIMIT + 1).count() > LIMIT:
            LOG.warning("%s: more than %d rows, left out of the map", what, LIMIT)
            return None
        return list(df.toLocalIterator())
    except Exception as e:  # one layer must not spoil the page
        LOG.warning("%s could not be drawn: %s", what, e)
        return None


def _cells(located: DataFrame) -> tuple[dict[int, list], list] | None:
    """The rows of each level of the pyramid that the page may hold, and the weighted places of its heat layer; None if that fails."""
    try:
        held = cut(layers.pyramid(located))
        size = {r["zoom"]: r["count"] for r in held.groupBy("zoom").count().collect()}
        levels, total = [], 0
        for z in sorted(size):  # at the least the coarsest
            total += size[z]
            if levels and total > LIMIT:
                break
            levels.append(z)
        rows: dict[int, list] = {z: [] for z in levels}
        for r in layers.cell_layer(held.where(F.col("zoom").isin(levels)), located).toLocalIterator():
            rows[r["zoom"]].append(r)
        heat = held.where(F.col("zoom") == levels[-1]).select("lat", "lon", "points")
        return rows, [[r["lat"], r["lon"], r["points"]] for r in heat.toLocalIterator()]
    except Exception as e:  # one layer must not spoil the page
        LOG.warning("points could not be drawn: %s", e)
        return None


def map_data(points: DataFrame, crs: Crs, roads: DataFrame | None = None, centroids: DataFrame | None = None, hulls: DataFrame | None = None, heat: bool = True) -> dict | None:
    """What the page shows; None without points, labels or valid coordinates."""
    if "cluster" not in points.columns or points.isEmpty():
        LOG.warning("no labelled points, no map")
        return None
    located = cut(layers.geographic(points.where(valid_point(F.col("x"), F.col("y"))), crs))
    center = layers.map_center(located).first()
    if center["lat"] is None:
        LOG.warning("no valid coordinates, no map")
        return None
    many = located.limit(LIMIT + 1).count() > LIMIT
    cells = _cells(located) if many else None
    shown = [] if many else _rows(layers.point_layer(located).select("cluster", "group_name", "shown", "lat", "lon", "radius", "color", "popup").orderBy("cluster"), "points") or []
    groups: dict[str, list] = {}
    for r in shown:
        groups.setdefault(r["group_name"], [r["group_name"], r["shown"], []])[2].append([r["lat"], r["lon"], r["radius"], r["color"], r["popup"]])
    data = {"center": [center["lat"], center["lon"]], "tiles": TILES, "groups": list(groups.values())}
    if cells is not None:
        data["cells"] = {z: [[r["lat"], r["lon"], r["kind"], r["color"], r["popup"], r["points"]] for r in rows] for z, rows in cells[0].items()}
    if roads is not None and (rows := _rows(layers.road_layer(roads, crs), "roads")) is not None:
        data["roads"] = [[json.loads(r["geojson"]), "<br>".join(html.escape(t) for t in r["tooltip"].split("<br>"))] for r in rows]
    if centroids is not None and (rows := _rows(layers.geographic(layers.centroid_layer(centroids, points), crs), "centroids")) is not None:
        data["centroids"] = [[r["lat"], r["lon"], r["popup"]] for r in rows]
    if hulls is not None:
        ring = F.transform(transform_vertices(F.col("ring"), crs, WGS84), lambda v: F.array(v["y"], v["x"]))
        hull_rows = layers.hull_layer(hulls, points).select(ring.alias("ring"), "color", "tooltip")
        if (rows := _rows(hull_rows, "hulls")) is not None:
            data["hulls"] = [[r["ring"], r["color"], r["tooltip"]] for r in rows]
    if heat and cells is not None:
        data["heat"] = cells[1]
    elif heat and (rows := _rows(layers.heat_layer(located), "heat map")) is not None:
        data["heat"] = [[r["lat"], r["lon"]] for r in rows]
    return data


def drawn(data: dict | None) -> tuple[int, int]:
    """How many labelled points the page shows, and how many points its heat layer stands on; cells count as what they hold."""
    if data is None:
        return 0, 0
    points = sum(len(g[2]) for g in data["groups"])
    if data.get("cells"):
        points = sum(r[5] for r in data["cells"][max(data["cells"])])
    return points, sum(r[2] if len(r) > 2 else 1 for r in data.get("heat", []))


def write_map(path: str, data: dict | None, title: str = "Clusters on the road network") -> bool:
    """Write the page; False if there is nothing to show."""
    if data is None:
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(PAGE % {"title": html.escape(title), "data": json.dumps(data).replace("</", "<\\/")})
    return True
