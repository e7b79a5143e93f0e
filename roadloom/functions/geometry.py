"""Plane geometry as column expressions, and well-known binary.

A point is two double columns; a line is ``parts``, an array of arrays of ``struct<x: double, y: double>``; an edge is
the four columns ``x1, y1, x2, y2`` of two consecutive vertices.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.session import ship

PARTS = "array<array<struct<x:double,y:double>>>"


def distance(a, b) -> float:
    """Euclidean distance of two points given as lists or tuples of two numbers."""
    for p in (a, b):
        if not isinstance(p, (list, tuple)):
            raise TypeError("a point is a list or tuple")
        if len(p) != 2:
            raise ValueError("a point has two coordinates")
    return math.hypot(a[0] - b[0], a[1] - b[1])


def squared(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def valid_point(x: Column, y: Column) -> Column:
    return finite(x) & finite(y)


def valid_line(parts: Column) -> Column:
    """Every part has two different vertices at least, and all coordinates are finite."""
    part_ok = lambda p: (F.size(F.array_distinct(p)) >= 2) & F.forall(p, lambda v: v.isNotNull() & finite(v["x"]) & finite(v["y"]))
    return F.coalesce((F.size(parts) > 0) & F.forall(parts, lambda p: p.isNotNull() & part_ok(p)), F.lit(False))


def non_empty(parts: Column) -> Column:
    return F.coalesce(F.exists(parts, lambda p: F.size(p) > 0), F.lit(False))


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """1, 0 or -1 as c lies left of, on, or right of a -> b. Differences come first, so large offsets cancel."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def boxes_meet(p: dict[str, Column], q: dict[str, Column], slack: float = 0.0) -> Column:
    low, high = F.least, F.greatest
    return (
        (low(p["x1"], p["x2"]) <= high(q["x1"], q["x2"]) + slack) & (low(q["x1"], q["x2"]) <= high(p["x1"], p["x2"]) + slack)
        & (low(p["y1"], p["y2"]) <= high(q["y1"], q["y2"]) + slack) & (low(q["y1"], q["y2"]) <= high(p["y1"], p["y2"]) + slack)
    )


def edges_intersect(p: dict[str, Column], q: dict[str, Column]) -> Column:
    """Whether two edges share a point; touching ends and collinear overlaps count."""
    side = lambda e, x, y: orientation(e["x1"], e["y1"], e["x2"], e["y2"], x, y)
    parts_q = side(p, q["x1"], q["y1"]) * side(p, q["x2"], q["y2"]) <= 0
    parts_p = side(q, p["x1"], p["y1"]) * side(q, p["x2"], p["y2"]) <= 0
    return boxes_meet(p, q) & parts_p & parts_q


def point_edge_squared(x: Column, y: Column, e: dict[str, Column]) -> Column:
    """Squared distance of a point to an edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / length)))
    return squared(x, y, e["x1"] + t * dx, e["y1"] + t * dy)


def edges_squared(p: dict[str, Column], q: dict[str, Column]) -> Column:
    """Squared distance of two edges."""
    ends = [point_edge_squared(a[f"x{k}"], a[f"y{k}"], b) for a, b in ((p, q), (q, p)) for k in (1, 2)]
    return F.when(edges_intersect(p, q), 0.0).otherwise(F.least(*ends))


def buffer_meets(p: dict[str, Column], q: dict[str, Column], tolerance: float) -> Column:
    """Whether edge ``q`` shares a point with the polygon around edge ``p``.

    The polygon is ``tolerance`` wide to both sides and has round ends of two chords a quarter circle; it is convex, so ``q`` meets
    it if the part of ``q`` that lies inside each of its ten sides isn't empty. Touching counts, within a billionth of the tolerance.
    """
    length = F.hypot(p["x2"] - p["x1"], p["y2"] - p["y1"])
    frame = F.struct(length.alias("length"), *((p[f"{c}2"] - p[f"{c}1"]).alias(f"d{c}") for c in "xy"), *((q[f"{c}{k}"] - p[f"{c}1"]).alias(f"{c}{k}") for c in "xy" for k in (1, 2)))
    inner = tolerance * math.cos(math.pi / 8)  # distance of a chord from its end's centre
    turns = [90, -90, 22.5, 67.5, -22.5, -67.5, 112.5, 157.5, -112.5, -157.5]
    sides = [(0.0 if abs(d) == 90 else math.cos(math.radians(d)), math.sin(math.radians(d)), (tolerance if abs(d) == 90 else inner) + 1e-9 * tolerance) for d in turns]
    listed = F.array(*(F.struct(F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), F.lit(limit).alias("limit")) for nx, ny, limit in sides))

    def beyond(f: Column, n: Column, k: int) -> Column:
        """How far an end of q lies outside of a side."""
        flat = f["length"] == 0
        ux, uy = F.when(flat, 1.0).otherwise(f["dx"] / f["length"]), F.when(flat, 0.0).otherwise(f["dy"] / f["length"])
        along, across = f[f"x{k}"] * ux + f[f"y{k}"] * uy, f[f"y{k}"] * ux - f[f"x{k}"] * uy
        return n["nx"] * along + n["ny"] * across - n["limit"] - F.greatest(n["nx"], F.lit(0.0)) * f["length"]

    def clipped(part: Column, e: Column) -> Column:
        """The part of q, from ``low`` to ``high`` of it, that is also inside this side."""
        cross = F.try_divide(e["first"], e["first"] - e["last"])
        low = F.when((e["first"] > 0) & (e["last"] > 0), 2.0).when(e["first"] > 0, cross).otherwise(0.0)
        return F.struct(F.greatest(part["low"], low).alias("low"), F.least(part["high"], F.when((e["first"] <= 0) & (e["last"] > 0), cross).otherwise(1.0)).alias("high"))

    ends = lambda f: F.transform(listed, lambda n: F.struct(beyond(f, n, 1).alias("first"), beyond(f, n, 2).alias("last")))
    whole = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return F.transform(F.array(frame), lambda f: F.aggregate(ends(f), whole, clipped, lambda part: part["low"] <= part["high"]))[0]


def edge_of(alias: str) -> dict[str, Column]:
    return {k: F.col(f"{alias}.{k}") for k in ("x1", "y1", "x2", "y2")}


def shoelace(ring: Column) -> Column:
    """Area of a closed ring, shifted to its first vertex first."""
    first = ring[0]
    moved = F.transform(ring, lambda v: F.struct((v["x"] - first["x"]).alias("x"), (v["y"] - first["y"]).alias("y")))
    crosses = F.zip_with(moved, F.slice(moved, 2, F.size(ring)), lambda a, b: F.coalesce(a["x"] * b["y"] - a["y"] * b["x"], F.lit(0.0)))
    return F.abs(F.aggregate(crosses, F.lit(0.0), lambda s, c: s + c)) / 2


# Well-known binary, little-endian.


def point_wkb(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def points_wkb(x: pa.Array, y: pa.Array) -> pa.Array:
    """The points of two columns, in arrays; null where a coordinate is."""
    held = np.empty(len(x), np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")]))
    held["order"], held["kind"] = 1, 1
    for name, c in (("x", x), ("y", y)):
        held[name] = c.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * held.itemsize)
    every = pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(held.tobytes())])
    known = np.array(x.is_valid()) & np.array(y.is_valid())
    return every if known.all() else every.take(pa.array(np.arange(len(x)), mask=~known))


def _ring(vertices: list[tuple[float, float]]) -> bytes:
    return struct.pack(f"<I{2 * len(vertices)}d", len(vertices), *(c for v in vertices for c in v))


def line_wkb(parts: list[list[tuple[float, float]]]) -> bytes:
    """A LineString for one part, a MultiLineString otherwise."""
    lines = [struct.pack("<BI", 1, 2) + _ring(p) for p in parts]
    return lines[0] if len(lines) == 1 else struct.pack("<BII", 1, 5, len(lines)) + b"".join(lines)


def polygon_wkb(ring: list[tuple[float, float]]) -> bytes:
    return struct.pack("<BII", 1, 3, 1) + _ring(ring)


def parse_wkb(data: bytes) -> tuple[str, list]:
    """Kind and coordinates: a point's one vertex, or the parts of lines and polygons."""
    at = 0

    def take(form: str):
        nonlocal at
        out = struct.unpack_from(order + form, data, at)
        at += struct.calcsize(order + form)
        return out

    def ring() -> list[tuple[float, float]]:
        (n,) = take("I")
        flat = take(f"{2 * n}d")
        return list(zip(flat[::2], flat[1::2]))

    def one() -> tuple[str, list]:
        nonlocal order, at
        order, at = "<" if data[at] else ">", at + 1
        (kind,) = take("I")
        if kind == 1:
            return "Point", [take("dd")]
        if kind == 2:
            return "LineString", [ring()]
        if kind == 3:
            return "Polygon", [ring() for _ in range(take("I")[0])]
        if kind == 5:
            return "MultiLineString", [part for _ in range(take("I")[0]) for part in one()[1]]
        raise ValueError(f"geometry kind {kind} is not supported")

    order = "<"
    return one()


def with_wkb(df: DataFrame, column: str = "wkb") -> DataFrame:
    """Add the geometry of points (``x``, ``y``), lines (``parts``) or polygons (``ring``) as well-known binary; null for null geometry."""
    ship(df.sparkSession)
    kind = "parts" if "parts" in df.columns else "ring" if "ring" in df.columns else "x"
    pairs = lambda vertices: [(v["x"], v["y"]) for v in vertices]

    def of(row: dict) -> bytes | None:
        if row[kind] is None:
            return None
        return line_wkb([pairs(p) for p in row["parts"]]) if kind == "parts" else polygon_wkb(pairs(row["ring"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if kind == "x":
                yield pa.record_batch([*batch.columns, points_wkb(batch.column("x"), batch.column("y"))], [*batch.schema.names, column])
                continue
            held = batch.select([kind]).to_pylist()
            yield pa.record_batch([*batch.columns, pa.array([of(r) for r in held], pa.binary())], [*batch.schema.names, column])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.BinaryType())]))


def from_wkb(df: DataFrame, column: str = "wkb") -> DataFrame:
    """Replace a column of well-known binary by ``kind`` and ``parts``."""
    ship(df.sparkSession)
    names = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vertex = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            read = [parse_wkb(b) if b is not None else (None, None) for b in batch.column(column).to_pylist()]
            kinds = pa.array([k for k, _ in read], pa.string())
            parts = pa.array([None if p is None else [[{"x": x, "y": y} for x, y in (part if isinstance(part, list) else [part])] for part in p] for _, p in read], vertex)
            yield pa.record_batch([*(batch.column(n) for n in names), kinds, parts], [*names, "kind", "parts"])

    schema = T.StructType([*(df.schema[n] for n in names), T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))])
    return df.select(*names, column).mapInArrow(run, schema)
