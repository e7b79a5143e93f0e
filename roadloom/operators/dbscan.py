"""Density clustering on a road network, in its order-free form.

Two points are neighbours if they are at most ``eps`` apart and their roads are the same, intersect, or have a common
intersecting road (points without a road only pair among themselves). A point is a core if it has ``min_pts - 1``
neighbours. A cluster is a component of cores, numbered by its least core index; other points take the least number of
an adjacent core, else -1.

Equal points on one road are one *site* with a weight. Sites of one road in one cell of side ``eps / 2`` are a
*clump*: all of them are neighbours, so

* no pairs inside a clump are made: a clump of ``min_pts`` points has cores only, and its cores are connected;
* a clump that has ``min_pts`` points together with the clumps all of whose points are within ``eps`` of all of its own (by their boxes) has cores
  only, too: it is *sure*. Neighbours are counted for the sites of other clumps only;
* clumps of one cell whose roads meet are compared first, and only those that this doesn't make sure look at all clumps around them. Sites are made
  of these, and of what is around them, only: where all clumps are sure, points are gathered once, by clumps, and take their clump's number;
* two sure clumps are linked if they are that near as a whole, or else if their outermost cores are; pairs of clumps that this leaves in different
  components, and whose boxes are within ``eps``, are cut into ever smaller cells (:mod:`roadloom.operators.closest`). Each step looks only at what
  the one before left in different components: clumps of one cell whose roads meet and of one road go first, and elsewhere pairs are made only of clumps in different ones.

So the work follows the number of points, also where a third of them stand within ``eps`` of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadloom.functions import geometry as g
from roadloom.operators.associate import NONE
from roadloom.operators.closest import touching
from roadloom.operators.components import CHUNK, connected_components
from roadloom.operators.keys import dense_index
from roadloom.operators.roads import allowed_pairs, linked_pairs, neighbours
from roadloom.session import cut, spread

NOISE = -1


def eps_pairs(points: DataFrame, eps: float) -> DataFrame:
    """All pairs ``i < j`` of points at most ``eps`` apart, whatever their roads. For reports; clustering doesn't use it."""
    cell = lambda c: F.floor(F.col(c) / eps).cast("long")
    rows = points.where(g.valid_point(F.col("x"), F.col("y"))).select("point_idx", "x", "y", F.coalesce("road_uid", F.lit(NONE).cast("bigint")).alias("road_uid"), cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    around = rows.withColumn("step", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("step.i"), "cy": F.col("cy") + F.col("step.j")})
    p, q = around.alias("p"), rows.alias("q")
    near = (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy")) & (F.col("p.point_idx") < F.col("q.point_idx")) & (g.squared(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y")) <= eps * eps)
    return p.join(q, near).select(F.col("p.point_idx").alias("i"), F.col("q.point_idx").alias("j"), F.col("p.road_uid").alias("uid_i"), F.col("q.road_uid").alias("uid_j"))


def unassociated_pairs(points: DataFrame, eps: float) -> DataFrame:
    """The pairs of :func:`constrained_pairs` of points without a road: these pair among themselves only, so no graph and no other points are looked at."""
    return eps_pairs(points.where(F.col("road_uid").isNull() | (F.col("road_uid") == NONE)), eps)


#: Points in one array, points of one place in one, and points of a cell that others are compared with at a time (about).
HELD, PLACED, GROUP = 512, 32768, 8192


def _pairing_roads(clumps: DataFrame, adjacent: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """``cx, cy, uid_p, bits``: the roads of a cell, by their ``place`` there, that hold neighbours of points of the road ``uid_p``, which has points in it or one of ``steps`` before it."""
    parts = spread(clumps.sparkSession, clumps.count())
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))
    around = clumps.select(F.explode(offsets).alias("s"), "cx", "cy", "road_uid").select((F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), F.col("road_uid").alias("uid_p"))
    around = around.repartition(parts, "cx", "cy").distinct()
    met = around.join(clumps.select("cx", "cy", F.col("road_uid").alias("uid_q"), "place").repartition(parts, "cx", "cy"), ["cx", "cy"])
    low, high = F.least("uid_p", "uid_q"), F.greatest("uid_p", "uid_q")
    both = met.where("uid_p <> uid_q").select(low.alias("uid_p"), high.alias("uid_q")).distinct()
    linked = linked_pairs(both, adjacent).toDF("low", "high")
    held = met.join(linked, (low == F.col("low")) & (high == F.col("high"))).select("cx", "cy", "uid_p", "place").union(met.where("uid_p = uid_q").select("cx", "cy", "uid_p", "place"))
    words = held.groupBy("cx", "cy", "uid_p", F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    listed = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda w: F.coalesce(F.col("listed")[w], F.lit(0).cast("long")))
    return words.groupBy("cx", "cy", "uid_p").agg(listed.alias("listed"), F.max("word").alias("last")).select("cx", "cy", "uid_p", whole.alias("bits"))


def constrained_pairs(points: DataFrame, adjacent: DataFrame, eps: float) -> DataFrame:
    """The pairs of :func:`eps_pairs` that are neighbours on the network.

    Which roads pair is settled for the roads of neighbouring cells. Points stand in arrays of one road in one cell, which are sent to half of
    the cells around; pairs of points are made there at the very end, where nothing is shuffled or gathered any more.
    """
    cell = lambda c: F.floor(F.col(c) / eps).cast("long").alias(f"c{c}")
    rows = points.where(g.valid_point(F.col("x"), F.col("y")) & F.col("point_idx").isNotNull()).select("point_idx", "x", "y", F.coalesce("road_uid", F.lit(NONE).cast("bigint")).alias("road_uid"), cell("x"), cell("y"))
    key, steps = ["cx", "cy", "road_uid"], [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    clumps = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("points"))
    of_cell = Window.partitionBy("cx", "cy")
    clumps = cut(clumps.withColumns({"place": F.row_number().over(of_cell.orderBy("road_uid")) - 1, "deals": F.ceil(F.sum("points").over(of_cell) / GROUP)}))
    # where the arrays of a clump are sent, and with which roads' points they pair there
    way = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    sent_to = clumps.select(*key, way.alias("s")).select(*key, (F.col("cx") + F.col("s.i")).alias("to_x"), (F.col("cy") + F.col("s.j")).alias("to_y"), F.expr("s.i = 0 and s.j = 0").alias("same"))
    bits = _pairing_roads(clumps, adjacent, steps).join(clumps.select("cx", "cy", "deals").distinct(), ["cx", "cy"]).toDF("to_x", "to_y", "road_uid", "bits", "deals")
    targets = sent_to.join(bits, ["to_x", "to_y", "road_uid"]).groupBy(*key).agg(F.collect_list(F.struct("to_x", "to_y", "same", "bits", "deals")).alias("targets"))
    # points of a clump in arrays by places; those of a crowded place are dealt out
    crowds = F.ceil(F.col("points") / PLACED)
    placed = rows.join(clumps, key).withColumns({"part": F.pmod(F.xxhash64("point_idx"), crowds), "nth": F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("points") / crowds / HELD))})
    whole = [*key, "part", "nth", "place", "deals"]
    sites = placed.repartition(*whole).groupBy(*whole, "x", "y").agg(F.collect_list("point_idx").alias("own")).groupBy(*whole).agg(F.collect_list(F.struct("x", "y", "own")).alias("sites"))
    held = cut(sites.join(targets, key))
    parts = spread(points.sparkSession, held.count())
    on = ["cx", "cy", "deal"]
    q = held.select("cx", "cy", F.pmod(F.xxhash64("road_uid", "part", "nth"), F.col("deals")).alias("deal"), F.col("road_uid").alias("uid_q"), "place", F.col("sites").alias("sites_q"))
    p = held.select(F.col("road_uid").alias("uid_p"), F.col("sites").alias("sites_p"), F.explode("targets").alias("t")).select("uid_p", "sites_p", F.col("t.to_x").alias("cx"), F.col("t.to_y").alias("cy"), "t.same", "t.bits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t.deals") - 1)).alias("deal"))
    pairing = F.expr("getbit(get(bits, cast(place div 64 as int)), cast(place % 64 as int)) = 1")
    met = p.repartition(parts, *on).join(q.repartition(parts, *on), on).where(pairing).select("uid_p", "uid_q", "same", "sites_q", F.explode("sites_p").alias("p"))
    met = met.select("uid_p", "uid_q", "same", "p", F.explode("sites_q").alias("q")).where(g.squared(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y")) <= eps * eps)
    met = met.select("uid_p", "uid_q", "same", F.explode("p.own").alias("a"), F.col("q.own").alias("others")).select("uid_p", "uid_q", "same", "a", F.explode("others").alias("b")).where("a < b or (not same and a <> b)")
    first = F.col("a") < F.col("b")
    either = lambda one, other: F.when(first, F.col(one)).otherwise(F.col(other))
    return met.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), either("uid_p", "uid_q").alias("uid_i"), either("uid_q", "uid_p").alias("uid_j"))


def _clumps(rows: DataFrame) -> DataFrame:
    """One row per clump of ``rows`` (points with ``cx, cy``): its number (its least point index), points and box."""
    box = {"x1": F.min("x"), "x2": F.max("x"), "y1": F.min("y"), "y2": F.max("y")}
    return rows.groupBy("cx", "cy", "road_uid").agg(F.min("point_idx").alias("clump"), F.count(F.lit(1)).alias("points"), *(c.alias(k) for k, c in box.items()))


def _outermost(rows: DataFrame) -> DataFrame:
    """``clump, outer``: the outermost places of each clump of ``rows``."""
    at = F.struct("x", "y")
    ways = [F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")]
    outer = [f(at, way) for way in ways for f in (F.min_by, F.max_by)]
    return rows.groupBy("clump").agg(F.array_distinct(F.array(*outer)).alias("outer"))


#: Offsets of the cells that hold clumps within ``eps``; ``HALF`` has one of each two opposite ones.
AROUND = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
HALF = [s for s in AROUND if s > (0, 0)]


def _near(clumps: DataFrame, others: DataFrame, eps: float, steps: list[tuple[int, int]], when: Column) -> DataFrame:
    """``a < b`` of a row ``p`` of ``clumps`` and ``q`` of ``others``, ``steps`` away, whose boxes are at most ``eps`` apart, their roads and points, and ``whole`` if all of their points are that near."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))
    around = clumps.withColumn("step", F.explode(offsets)).withColumns({"cx": F.col("cx") + F.col("step.i"), "cy": F.col("cy") + F.col("step.j")})
    p, q = around.alias("p"), others.alias("q")
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"p.{k}1") - F.col(f"q.{k}2"), F.col(f"q.{k}1") - F.col(f"p.{k}2"))
    near = (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy")) & when & (gap("x") * gap("x") + gap("y") * gap("y") <= eps * eps)
    span = lambda k: F.greatest(F.abs(F.col(f"p.{k}2") - F.col(f"q.{k}1")), F.abs(F.col(f"q.{k}2") - F.col(f"p.{k}1")))
    whole = span("x") * span("x") + span("y") * span("y") <= eps * eps
    ordered = lambda k, a, b: (F.least(f"p.{k}", f"q.{k}").alias(a), F.greatest(f"p.{k}", f"q.{k}").alias(b))
    turned = F.col("p.clump") > F.col("q.clump")
    weigh = [F.when(turned, F.col(f"{t}.points")).otherwise(F.col(f"{s}.points")).alias(f"points_{k}") for k, s, t in (("a", "p", "q"), ("b", "q", "p"))]
    return p.join(q, near).select(*ordered("clump", "a", "b"), *ordered("road_uid", "uid_a", "uid_b"), *weigh, whole.alias("whole"))


_PAIR = ["a", "b", "points_a", "points_b", "whole"]


def _facing(clumps: DataFrame) -> DataFrame:
    """The ``clumps`` (with their ``part``) around whose cells there are several parts."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND))
    seen = clumps.groupBy("cx", "cy").agg(F.min("part").alias("low"), F.max("part").alias("high")).withColumn("step", F.explode(offsets))
    seen = seen.groupBy((F.col("cx") + F.col("step.i")).alias("cx"), (F.col("cy") + F.col("step.j")).alias("cy")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return clumps.join(seen.where("low < high").select("cx", "cy"), ["cx", "cy"], "left_semi")


def _joined(parts: DataFrame, more: DataFrame) -> DataFrame:
    """Components ``parts`` after links ``more`` (``a, b``) between components, and between nodes that are in none."""
    up = cut(connected_components(more))
    if up.isEmpty():
        return parts
    root = up.select(F.col("node").alias("component"), F.col("component").alias("root"))
    moved = parts.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return cut(moved.union(up.join(parts.select("node"), "node", "left_anti").select("node", "component")))


def _place(side: float) -> tuple[Column, Column, Column]:
    """A point's cell (null where its coordinates aren't valid) and road."""
    ok = g.valid_point(F.col("x"), F.col("y"))
    cell = lambda c: F.when(ok, F.floor(F.col(c) / side).cast("long"))
    return cell("x"), cell("y"), F.coalesce(F.col("road_uid").cast("bigint"), F.lit(NONE).cast("bigint"))


def _labels(points: DataFrame, adjacent: DataFrame | None, eps: float, min_pts: int, known: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """``cx, cy, road_uid, cluster`` of the clumps that are sure, and ``x, y, road_uid, core, cluster`` of the sites of others (``None`` if there are none).

    Points are only gathered by clumps; sites are made around the clumps that aren't sure.
    """
    side = eps / 2
    cx, cy, uid = _place(side)
    rows = points.where(g.valid_point(F.col("x"), F.col("y"))).select("point_idx", "x", "y", uid.alias("road_uid"), cx.alias("cx"), cy.alias("cy"))
    clumps = cut(_clumps(rows))
    boxes = ["clump", "cx", "cy", "road_uid", "points", "x1", "x2", "y1", "y2"]
    cell = ["cx", "cy", "road_uid"]
    first = F.col("p.clump") < F.col("q.clump")
    held_lists = [known]

    def allowed(pairs: DataFrame) -> DataFrame:
        """The pairs whose roads may hold neighbours, without these. Without a graph all roads pair."""
        if adjacent is None:
            return pairs.select(_PAIR)
        held_lists[0] = held_lists[0] if held_lists[0] is not None else neighbours(adjacent)
        return allowed_pairs(pairs, adjacent, "uid_a", "uid_b", held_lists[0]).select(_PAIR)

    def turned(held: DataFrame) -> DataFrame:
        way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(f"points_{a}").alias("own"), F.col(f"points_{b}").alias("other"))
        return held.select(F.inline(F.array(way("a", "b"), way("b", "a"))))

    def counted(held: DataFrame, pairs: DataFrame) -> DataFrame:
        """Whether clumps are ``sure`` by their own points and those of the clumps that ``pairs`` have near as a whole."""
        around = turned(pairs.where("whole")).where(F.col("own") < min_pts).groupBy(F.col("a").alias("clump")).agg(F.sum("other").alias("around"))
        return cut(held.join(around, "clump", "left").withColumn("sure", F.col("points") + F.coalesce("around", F.lit(0)) >= min_pts).drop("around"))

    # clumps of one cell whose roads meet first; what these don't make sure looks at all clumps around it
    direct = _near(clumps.select(boxes), clumps.select(boxes), eps, [(0, 0)], first)
    direct = direct if adjacent is None else direct.join(adjacent.select("uid_a", "uid_b"), ["uid_a", "uid_b"], "left_semi")
    direct = cut(direct.where("whole").select(_PAIR))
    clumps = counted(clumps, direct)
    pairs = few = met = None
    if not clumps.where("not sure").isEmpty():
        once = F.col("q.sure") | first
        pairs = cut(allowed(_near(clumps.where("not sure").select(boxes), clumps.select(*boxes, "sure"), eps, AROUND, once)))
        clumps = counted(clumps.withColumnRenamed("sure", "_sure"), pairs).withColumn("sure", F.col("_sure") | F.col("sure")).drop("_sure")
    unsure = clumps.where("not sure").select("clump")
    whole = direct if pairs is None else direct.union(pairs.where("whole"))
    steady = clumps.where("sure").select(boxes)
    heads = steady.select("clump", F.col("clump").alias("least"))  # clumps with cores, and the least core of each
    links = None
    if not unsure.isEmpty():
        # neighbours of the sites of clumps that aren't sure
        itself = unsure.select(F.col("clump").alias("a"), F.col("clump").alias("b"))
        both = turned(pairs).select("a", "b").union(itself).join(itself.select("a"), "a", "left_semi")
        named = clumps.join(both.select(F.col("b").alias("clump")).distinct(), "clump", "left_semi").select(*cell, "clump", "sure")
        near_by = rows.join(named, cell).groupBy("x", "y", "road_uid", "clump", "sure").agg(F.min("point_idx").alias("site"), F.count(F.lit(1)).alias("weight"))
        near_by = cut(near_by)
        few = near_by.where("not sure")
        other = near_by.select(F.col("clump").alias("b"), F.col("site").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("weight").alias("weight2"))
        near = (F.col("site") != F.col("other")) & (g.squared(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) <= eps * eps)
        met = cut(few.select("site", "clump", "x", "y").join(both, F.col("clump") == F.col("a")).join(other, "b").where(near).select("site", "clump", "other", F.col("b").alias("other_clump"), "weight2"))
        degree = met.groupBy("site").agg(F.sum("weight2").alias("degree"))
        few = cut(few.join(degree, "site", "left").withColumn("core", F.coalesce("degree", F.lit(0)) + F.col("weight") >= min_pts).drop("degree", "weight", "sure"))
        core_sites = cut(few.where("core").select("site").union(near_by.where("sure").select("site")))
        met = met.join(core_sites.select(F.col("site").alias("other")), "other", "left_semi")
        links = met.join(core_sites, "site", "left_semi").select(F.col("clump").alias("a"), F.col("other_clump").alias("b")).where("a <> b")
        heads = heads.union(few.where("core").groupBy("clump").agg(F.min("site").alias("least")))
        whole = whole.join(unsure.select(F.col("clump").alias("a")), "a", "left_anti").join(unsure.select(F.col("clump").alias("b")), "b", "left_anti").select(_PAIR)
    # sure clumps: the least and the greatest that are near as a whole in one cell, or all on one road, first; then the others that are still apart, then by their outermost cores
    ends = turned(whole).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    linked = ends.select("a", F.explode(F.array("low", "high")).alias("b"))
    along = _near(steady, steady, eps, HALF, F.col("p.road_uid") == F.col("q.road_uid")).where("whole").select("a", "b")
    linked = linked.union(along)
    parts = cut(connected_components(linked if links is None else linked.union(links), few=CHUNK))

    def apart(held: DataFrame) -> DataFrame:
        """Pairs of clumps in different components, and these."""
        of = lambda k: parts.select(F.col("node").alias(k), F.col("component").alias(f"part_{k}"))
        named = held.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"part_a": F.coalesce("part_a", "a"), "part_b": F.coalesce("part_b", "b")})
        return cut(named.where("part_a <> part_b"))

    part = F.coalesce("component", "clump").alias("part")
    facing = cut(_facing(steady.join(parts.withColumnRenamed("node", "clump"), "clump", "left").select(*boxes, part)))
    if not facing.isEmpty():
        left = apart(allowed(_near(facing, facing, eps, [(0, 0), *HALF], F.col("p.part") != F.col("q.part"))).select("a", "b", "whole").distinct())
        parts = _joined(parts, left.where("whole").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
        left = left.where("not whole").select("a", "b")
        left = left if left.isEmpty() else apart(left)
        if not left.isEmpty():
            these = left.select(F.col("a").alias("clump")).union(left.select(F.col("b").alias("clump"))).distinct()
            places = cut(rows.join(clumps.join(these, "clump", "left_semi").select(*cell, "clump"), cell).select("clump", "x", "y").distinct())
            outer = cut(_outermost(places))
            of = lambda k: outer.select(F.col("clump").alias(k), F.col("outer").alias(f"outer_{k}"))
            close = lambda p, q: g.squared(p["x"], p["y"], q["x"], q["y"]) <= eps * eps
            met_there = F.exists("outer_a", lambda p: F.exists("outer_b", lambda q: close(p, q)))
            wide = cut(left.join(of("a"), "a").join(of("b"), "b").select("a", "b", "part_a", "part_b", met_there.alias("linked")))
            parts = _joined(parts, wide.where("linked").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
            left = apart(wide.where("not linked").select("a", "b"))
            if not left.isEmpty():
                found = touching(left, places.withColumnRenamed("clump", "group"), eps, side)
                parts = _joined(parts, left.join(found, ["a", "b"], "left_semi").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
    heads = heads.join(parts.withColumnRenamed("node", "clump"), "clump", "left").withColumn("component", F.coalesce("component", "clump"))
    numbered = dense_index(heads.groupBy("component").agg(F.min("least").alias("least")), ["least"], "cluster", 1).select("component", "cluster")
    heads = heads.join(numbered, "component").select("clump", "cluster")
    if few is None:
        return steady.select(*cell, "clump").join(heads, "clump").select(*cell, "cluster"), None
    heads = cut(heads)
    border = met.join(heads.select(F.col("clump").alias("other_clump"), "cluster"), "other_clump").groupBy("site").agg(F.min("cluster").alias("border"))
    label = F.when(F.col("core"), F.col("cluster")).otherwise(F.coalesce("border", F.lit(NOISE)))
    few = few.join(heads, "clump", "left").join(border, "site", "left").select("x", "y", "road_uid", "core", label.alias("cluster"))
    return steady.select(*cell, "clump").join(heads, "clump").select(*cell, "cluster"), few


def check_arguments(eps: float, min_pts: int) -> None:
    if isinstance(eps, bool) or not isinstance(eps, (int, float)) or not eps > 0:
        raise ValueError("eps must be a positive number")
    if isinstance(min_pts, bool) or not isinstance(min_pts, int) or min_pts < 2:
        raise ValueError("min_pts must be a whole number of 2 or more")


def cluster(points: DataFrame, adjacent: DataFrame | None, eps: float, min_pts: int, known: DataFrame | None = None) -> DataFrame:
    """``points`` (``point_idx, x, y, road_uid``) with ``core`` and ``cluster`` (-1: noise).

    No points give no rows. Without a graph (``None``) all points are noise; a graph without rows is fine. Points
    with invalid coordinates are noise. ``known``: :func:`roadloom.operators.roads.neighbours` of ``adjacent``, if that is at hand.
    """
    check_arguments(eps, min_pts)
    if "road_uid" not in points.columns:
        raise ValueError("points lack road_uid; associate them first")
    if adjacent is None:
        return points.withColumns({"core": F.lit(False), "cluster": F.lit(NOISE).cast("bigint")})
    return _labelled(points, adjacent, eps, min_pts, known)


def cluster_plain(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """Clustering by distance alone: what the network constraint changes."""
    check_arguments(eps, min_pts)
    kept = points.withColumnRenamed("road_uid", "_own_uid").withColumn("road_uid", F.lit(0).cast("bigint"))
    return _labelled(kept, None, eps, min_pts).drop("road_uid").withColumnRenamed("_own_uid", "road_uid")


def _labelled(points: DataFrame, adjacent: DataFrame | None, eps: float, min_pts: int, known: DataFrame | None = None) -> DataFrame:
    sure, few = _labels(points, adjacent, eps, min_pts, known)
    cx, cy, uid = _place(eps / 2)
    joined = points.withColumns({"_cx": cx, "_cy": cy, "_uid": uid}).join(sure.toDF("_cx", "_cy", "_uid", "_sure"), ["_cx", "_cy", "_uid"], "left")
    core, label = F.col("_sure").isNotNull(), F.col("_sure")
    if few is not None:
        few = few.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("road_uid").alias("_few_uid"), F.col("core").alias("_core"), F.col("cluster").alias("_few"))
        joined = joined.join(few, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("_uid") == F.col("_few_uid")), "left")
        core, label = core | F.coalesce("_core", F.lit(False)), F.coalesce(label, "_few")
    labelled = joined.withColumns({"core": core, "cluster": F.coalesce(label, F.lit(NOISE)).cast("bigint")})
    return labelled.select(*points.columns, "core", "cluster")
