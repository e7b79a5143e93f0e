"""The road functions in SQL text: functions and a table function of the session, and nearest roads as one statement."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import crs
from roadloom.session import ship


class RingCells:
    """``ring_cells(cx, cy, r)``: the cells whose larger offset from a cell is ``r``."""

    def eval(self, cx: int, cy: int, r: int) -> Iterator[tuple[int, int]]:
        if cx is None or cy is None or r is None or r < 0:
            return
        if r == 0:
            yield cx, cy
            return
        for k in range(-r, r):
            yield cx + k, cy - r
            yield cx + r, cy + k
            yield cx - k, cy + r
            yield cx - r, cy - k


def statements() -> list[str]:
    """The functions, each made of the ones before it."""
    e, radius, _, alpha, _ = crs._constants(crs.utm(31))  # the same for every zone
    # Scale and false easting belong to the zones' definition.
    north = " + ".join(["xi", *(f"{a:.20f}D * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    east = " + ".join(["eta", *(f"{a:.20f}D * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    edge = "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
    return [
        "road_distance(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE RETURN hypot(x1 - x2, y1 - y2)",
        "road_square(dx DOUBLE, dy DOUBLE) RETURNS DOUBLE RETURN dx * dx + dy * dy",
        f"road_along(px DOUBLE, py DOUBLE, {edge}) RETURNS DOUBLE RETURN CASE WHEN x1 = x2 AND y1 = y2 THEN 0D ELSE greatest(0D, least(1D, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / road_square(x2 - x1, y2 - y1))) END",
        f"road_edge_square(px DOUBLE, py DOUBLE, {edge}, t DOUBLE) RETURNS DOUBLE RETURN road_square(px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1)))",
        f"road_point_edge(px DOUBLE, py DOUBLE, {edge}) RETURNS DOUBLE RETURN sqrt(road_edge_square(px, py, x1, y1, x2, y2, road_along(px, py, x1, y1, x2, y2)))",
        "road_turn(ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE, cx DOUBLE, cy DOUBLE) RETURNS DOUBLE RETURN signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))",
        f"""road_edges_meet({edge}, u1 DOUBLE, v1 DOUBLE, u2 DOUBLE, v2 DOUBLE) RETURNS BOOLEAN RETURN
            least(x1, x2) <= greatest(u1, u2) AND least(u1, u2) <= greatest(x1, x2) AND least(y1, y2) <= greatest(v1, v2) AND least(v1, v2) <= greatest(y1, y2)
            AND road_turn(x1, y1, x2, y2, u1, v1) * road_turn(x1, y1, x2, y2, u2, v2) <= 0 AND road_turn(u1, v1, u2, v2, x1, y1) * road_turn(u1, v1, u2, v2, x2, y2) <= 0""",
        f"utm_level(sine DOUBLE) RETURNS DOUBLE RETURN sinh(atanh(sine) - {e!r}D * atanh({e!r}D * sine))",
        "utm_xi(t DOUBLE, turn DOUBLE) RETURNS DOUBLE RETURN atan2(t, cos(turn))",
        "utm_eta(t DOUBLE, turn DOUBLE) RETURNS DOUBLE RETURN atanh(sin(turn) / sqrt(1 + t * t))",
        f"utm_east_of(xi DOUBLE, eta DOUBLE) RETURNS DOUBLE RETURN 500000 + {radius!r}D * ({east})",
        f"utm_north_of(xi DOUBLE, eta DOUBLE) RETURNS DOUBLE RETURN {radius!r}D * ({north})",
        "utm_turn(lon DOUBLE, zone INT) RETURNS DOUBLE RETURN radians(lon - (6 * zone - 183))",
        "utm_easting(lon DOUBLE, lat DOUBLE, zone INT) RETURNS DOUBLE RETURN utm_east_of(utm_xi(utm_level(sin(radians(lat))), utm_turn(lon, zone)), utm_eta(utm_level(sin(radians(lat))), utm_turn(lon, zone)))",
        "utm_northing(lon DOUBLE, lat DOUBLE, zone INT) RETURNS DOUBLE RETURN utm_north_of(utm_xi(utm_level(sin(radians(lat))), utm_turn(lon, zone)), utm_eta(utm_level(sin(radians(lat))), utm_turn(lon, zone)))",
    ]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session: ``road_distance``, ``road_point_edge``, ``road_edges_meet``, ``utm_easting``, ``utm_northing`` (north of the equator as it is, south of it negative) and ``ring_cells``."""
    for text in statements():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    ship(spark)
    spark.udtf.register("ring_cells", F.udtf(RingCells, returnType="cx: bigint, cy: bigint"))


def nearest_text(points: str, edges: str, side: float, levels: int) -> str:
    """The statement that finds the nearest road of each row of ``points`` (``point_idx, x, y``) in ``edges`` (``road_uid, x1, y1, x2, y2``).

    Cells of ``side``, doubled at each level, as in :mod:`roadloom.operators.associate`: what lies in the cells around a place at the first
    level that has anything there is under three sides away, so the cells around it two levels up hold all that can be nearer. Equal edges and
    equal places are looked at once; an edge stands in the cells that its line crosses, not in those of its box.
    """
    size, last = f"({float(side)!r}D * pow(2D, level))", levels - 1
    cell = lambda c: f"CAST(floor({c} / {size}) AS BIGINT)"
    # an edge's part in the column ``cx`` of cells, a little more
    bound = lambda c: f"least(greatest({c}, least(x1, x2)), greatest(x1, x2))"
    on = lambda c: f"(CASE WHEN x1 = x2 THEN y1 ELSE y1 + ({bound(c)} - x1) * (y2 - y1) / (x2 - x1) END)"
    left, right = on(f"(cx * {size} - {size} * 1e-9D)"), on(f"((cx + 1) * {size} + {size} * 1e-9D)")
    low = f"CASE WHEN x1 = x2 THEN least(y1, y2) ELSE greatest(least(y1, y2), least({left}, {right}) - {size} * 1e-9D) END"
    high = f"CASE WHEN x1 = x2 THEN greatest(y1, y2) ELSE least(greatest(y1, y2), greatest({left}, {right}) + {size} * 1e-9D) END"
    return f"""WITH lines AS (SELECT x1, y1, x2, y2, min(road_uid) AS road_uid FROM {edges} GROUP BY x1, y1, x2, y2),
        places AS (SELECT DISTINCT x, y FROM {points}),
        reg AS (SELECT *, explode(sequence({cell(low)}, {cell(high)})) AS cy FROM (
            SELECT *, explode(sequence({cell("least(x1, x2)")}, {cell("greatest(x1, x2)")})) AS cx FROM (
                SELECT road_uid, x1, y1, x2, y2, explode(sequence(0, {last})) AS level FROM lines))),
        held AS (SELECT DISTINCT level, cx, cy FROM reg),
        own AS (SELECT px, py, level, CAST(floor(px / pow(2D, level)) AS BIGINT) AS ux, CAST(floor(py / pow(2D, level)) AS BIGINT) AS uy FROM (
            SELECT px, py, explode(sequence(0, {last})) AS level FROM (SELECT DISTINCT CAST(floor(x / {float(side)!r}D) AS BIGINT) AS px, CAST(floor(y / {float(side)!r}D) AS BIGINT) AS py FROM places))),
        ring AS (SELECT r.cx AS i, r.cy AS j FROM (SELECT explode(array(0, 1)) AS r) o, LATERAL ring_cells(0, 0, o.r) r),
        taken AS (SELECT DISTINCT level, cx + i AS ux, cy + j AS uy FROM held CROSS JOIN ring),
        first AS (SELECT px, py, least(min(level) + 2, {last}) AS level FROM own JOIN taken USING (level, ux, uy) GROUP BY px, py),
        asked AS (SELECT p.x, p.y, f.level, CAST(floor(px / pow(2D, f.level)) AS BIGINT) AS ux, CAST(floor(py / pow(2D, f.level)) AS BIGINT) AS uy
            FROM places p JOIN first f ON CAST(floor(p.x / {float(side)!r}D) AS BIGINT) = f.px AND CAST(floor(p.y / {float(side)!r}D) AS BIGINT) = f.py),
        wanted AS (SELECT DISTINCT level, ux, uy FROM asked),
        near AS (SELECT DISTINCT w.level, w.ux, w.uy, reg.road_uid, reg.x1, reg.y1, reg.x2, reg.y2 FROM (SELECT level, ux, uy, ux + i AS cx, uy + j AS cy FROM wanted CROSS JOIN ring) w JOIN reg USING (level, cx, cy)),
        met AS (SELECT a.x, a.y, min(struct(road_point_edge(a.x, a.y, n.x1, n.y1, n.x2, n.y2) AS far, n.road_uid AS road_uid)) AS best FROM asked a JOIN near n USING (level, ux, uy) GROUP BY a.x, a.y)
        SELECT p.point_idx, met.best.road_uid AS road_uid, met.best.far AS dist_to_road FROM {points} p JOIN met ON p.x = met.x AND p.y = met.y"""


def _side(points: DataFrame, edges: DataFrame, side: float) -> float:
    """``side``, halved while it is wider than the places and the lines are apart: as many cells as places, of the mean gap between lines or more."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    low, high = (lambda *cs: F.min(F.least(*cs))), (lambda *cs: F.max(F.greatest(*cs)))
    lines = edges.groupBy("x1", "y1", "x2", "y2").agg(F.lit(1))
    total, area = lines.agg(F.sum(length), (high("x1", "x2") - low("x1", "x2")) * (high("y1", "y2") - low("y1", "y2"))).first()
    places = points.select("x", "y").distinct().count()
    least = max((2 * area / places) ** 0.5, area / total) if places and total and area else side
    while side > 2 * least:
        side /= 2
    return side


def nearest(points: DataFrame, edges: DataFrame, side: float, extent: float) -> DataFrame:
    """:func:`nearest_text` over two DataFrames; ``extent`` is the longer side of the box around both."""
    spark = points.sparkSession
    register(spark)
    side, levels = _side(points, edges, side), 1
    while side * 2 ** (levels - 1) < extent:
        levels += 1
    points.createOrReplaceTempView("roadloom_points")
    edges.createOrReplaceTempView("roadloom_edges")
    return spark.sql(nearest_text("roadloom_points", "roadloom_edges", side, levels))
