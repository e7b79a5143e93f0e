"""The road graph: edges, grid cells, intersections, adjacency and reach.

Candidate pairs come from an equi-join on grid cells; an edge is registered in the cells its own line crosses, not in
all cells of its box, so long slanted roads stay cheap. Exact predicates then decide in the same join. Cells of over ``DENSE`` edges are
split where that halves the pairs to test, or costs no copies (a quadtree by counts); elsewhere, as around a point that very many roads
cross, a cell's edges are dealt into blocks of that size and each pair of blocks is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.session import cut, spread

#: Edges that a cell may hold; cells a side that one is split into; times that it may be.
DENSE, FINER, DEEPEST = 256, 4, 8
#: Roads with more crossings are compared with each other by bitmaps.
HEAVY = 4096
#: Numbers of equal roads that stand in one array; crossings that a road may have for these to stand in one.
DEAL, LISTED = 512, 512
#: Up to this many roads, the numbers of equal ones are sent to all tasks that make pairs of them.
SENT = 500_000
_EDGE = ["road_uid", "x1", "y1", "x2", "y2"]


def edges(roads: DataFrame) -> DataFrame:
    """``road_uid, x1, y1, x2, y2``: one row for two consecutive vertices of a part."""
    pair = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    runs = F.transform("parts", lambda p: F.when(F.size(p) > 1, F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), pair)))
    return roads.select("road_uid", F.explode(F.flatten(F.filter(runs, lambda r: r.isNotNull()))).alias("e")).select("road_uid", "e.*")


def cell_size(edge_rows: DataFrame, slack: float = 0.0, dense: int = DENSE) -> float:
    """Twice the median edge length, or less (down to a 32nd) where cells of that side would hold over half of ``dense`` edges on average; 1 if there are none."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    low, high = (lambda a, b: F.min(F.least(a, b))), (lambda a, b: F.max(F.greatest(a, b)))
    n, median, total, x1, x2, y1, y2 = edge_rows.agg(F.count(F.lit(1)), F.percentile_approx(length, 0.5), F.sum(length), low("x1", "x2"), high("x1", "x2"), low("y1", "y2"), high("y1", "y2")).first()
    if not median:
        return 1.0
    side, area = 2 * median, (x2 - x1) * (y2 - y1)
    while side > median / 16 and area * dense < 2 * (side + 2 * slack) * (total + n * (side + 2 * slack)):
        side /= 2
    return side


def _whole(c: Column) -> Column:
    return F.floor(c).cast("long")


def cells_of_edge(side: float | Column, slack: float | Column = 0.0, within: int | None = None) -> Column:
    """Cells (``cx``, ``cy``) within ``slack`` of an edge; a little more, never fewer.

    ``within``: only those of the ``within`` x ``within`` cells that make up the larger cell in the columns ``cx`` and ``cy``.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    pad = slack + 1e-9 * side
    low_x, high_x = F.least(x1, x2), F.greatest(x1, x2)
    none = F.array().cast("array<bigint>")

    def run(low: Column, high: Column, up: str) -> Column:
        low, high = _whole(low / side), _whole(high / side)
        if within is None:
            return F.sequence(low, high)
        low, high = F.greatest(low, F.col(up) * within), F.least(high, F.col(up) * within + within - 1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(none)

    columns = run(low_x - pad, high_x + pad, "cx")
    slope = (y2 - y1) / (x2 - x1)

    def of_column(cx: Column) -> Column:
        left, right = F.greatest(low_x, cx * side - pad), F.least(high_x, (cx + 1) * side + pad)
        at = lambda x: y1 + (F.least(F.greatest(x, low_x), high_x) - x1) * slope
        steep = x1 == x2
        low = F.when(steep, F.least(y1, y2)).otherwise(F.greatest(F.least(y1, y2), F.least(at(left), at(right)) - 1e-9 * side))
        high = F.when(steep, F.greatest(y1, y2)).otherwise(F.least(F.greatest(y1, y2), F.greatest(at(left), at(right)) + 1e-9 * side))
        return F.transform(run(low - pad, high + pad, "cy"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(columns, of_column))


def leaves(edge_rows: DataFrame, side: float, slack: float = 0.0, dense: int = DENSE) -> DataFrame:
    """Every edge in each leaf that it crosses: ``road_uid, x1, y1, x2, y2, level, cx, cy, n``; ``n`` edges stand in a leaf that is too dense (else 0)."""
    cell, pairs = ["cx", "cy"], lambda n: F.col(n).cast("double") * F.col(n)
    now = cut(edge_rows.withColumn("cell", F.explode(cells_of_edge(side, slack))).select(*_EDGE, "cell.*"))
    done = None
    for level in range(DEEPEST + 1):
        held = lambda rows, n: rows.select(*_EDGE, F.lit(level).alias("level"), *cell, n.cast("long").alias("n"))  # noqa: B023, E731
        counts = now.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense)
        counts = cut(counts)
        if counts.isEmpty():
            return held(now, F.lit(0)) if done is None else done.union(held(now, F.lit(0)))
        full = now.join(counts, cell)
        done = held(now.join(counts, cell, "left_anti"), F.lit(0)) if done is None else done.union(held(now.join(counts, cell, "left_anti"), F.lit(0)))
        if level == DEEPEST:
            break
        side /= FINER
        inner = cut(full.withColumn("cell", F.explode(cells_of_edge(side, slack, FINER))).select(*_EDGE, "n", F.col("cx").alias("up_x"), F.col("cy").alias("up_y"), "cell.*"))
        after = inner.groupBy("n", "up_x", "up_y", *cell).agg(F.count(F.lit(1)).alias("m")).groupBy("n", "up_x", "up_y").agg(F.sum(pairs("m")).alias("after"), F.sum("m").alias("rows"))
        gain = (F.col("after") <= pairs("n") / 2) | (F.col("rows") <= 1.25 * F.col("n"))  # fewer pairs, or no more rows on the way to a level that has
        better = cut(after.where(gain).select("up_x", "up_y"))
        whole = better.withColumnsRenamed({"up_x": "cx", "up_y": "cy"})
        done = done.union(held(full.join(whole, cell, "left_anti"), F.col("n")))
        now = inner.join(better, ["up_x", "up_y"], "left_semi").select(*_EDGE, *cell)
    return done.union(held(full, F.col("n")))


def dealt(leaf_rows: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges of leaves that are too dense in blocks, once for each pair of blocks (``low <= high``) that theirs (``own``) is part of."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / dense)).cast("int")
    own = F.pmod(F.xxhash64(*_EDGE), F.col("blocks")).cast("int")
    rows = leaf_rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(*_EDGE, "level", "cx", "cy", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def unlike(roads: DataFrame) -> DataFrame:
    """``road_uid, parts``: of roads of one geometry the one with the lowest number. A road crosses what its equals cross, and them."""
    return roads.where("road_uid is not null and parts is not null").groupBy("parts").agg(F.min("road_uid").alias("road_uid")).select("road_uid", "parts")


def members(roads: DataFrame, alike: DataFrame) -> DataFrame:
    """``like, nth, own``: the numbers of all roads equal to ``like``, a row of :func:`unlike`, in arrays of about ``DEAL``."""
    rows = roads.select("road_uid", "parts").join(alike.select(F.col("road_uid").alias("like"), "parts"), "parts").select("like", "road_uid").distinct()
    many = alike.select(F.col("road_uid").alias("like")).join(rows.groupBy("like").agg(F.ceil(F.count(F.lit(1)) / DEAL).alias("deals")), "like")
    dealt_out = rows.join(many, "like").withColumn("nth", F.pmod(F.xxhash64("road_uid"), F.col("deals")))
    return dealt_out.groupBy("like", "nth").agg(F.collect_list("road_uid").alias("own"))


def _near(slack: float, mode: str) -> Column:
    """Whether the edges ``p`` and ``q`` meet."""
    p, q = g.edge_of("p"), g.edge_of("q")
    if not slack:
        return g.edges_intersect(p, q)
    if mode == "effective":
        return g.boxes_meet(p, q, slack) & (g.edges_squared(p, q) <= slack * slack)
    return g.boxes_meet(p, q, slack) & (g.buffer_meets(p, q, slack) | g.buffer_meets(q, p, slack))


def intersections_unlike(alike: DataFrame, tolerance: float = 0.0, tolerance_mode: str = "compat", side: float | None = None, dense: int = DENSE) -> DataFrame:
    """:func:`intersections` without a look for equal roads."""
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    if tolerance_mode not in ("compat", "effective", "buffer"):
        raise ValueError("tolerance_mode is 'compat', 'effective' or 'buffer'")
    slack = 0.0 if tolerance_mode == "compat" else tolerance
    rows = cut(edges(alike))
    count = rows.count()
    rows = dealt(leaves(rows, side or cell_size(rows, slack / 2, dense), slack / 2, dense), dense)
    keys = ["level", "cx", "cy", "low", "high"]
    rows = rows.repartition(spread(alike.sparkSession, count), *keys)
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"p.{k}") == F.col(f"q.{k}")
    apart = (F.col("p.low") == F.col("p.high")) | (F.col("p.own") != F.col("q.own"))
    met = rows.alias("p").join(rows.alias("q"), same & apart & (F.col("p.road_uid") < F.col("q.road_uid")) & _near(slack, tolerance_mode))
    return met.select(F.col("p.road_uid").alias("uid_a"), F.col("q.road_uid").alias("uid_b")).distinct()


def intersections(roads: DataFrame, tolerance: float = 0.0, tolerance_mode: str = "compat", side: float | None = None, dense: int = DENSE) -> DataFrame:
    """Pairs ``uid_a < uid_b`` of roads that share a point, each once.

    In the ``'compat'`` mode the tolerance has no effect (candidates already touch); ``'effective'`` also takes roads at
    most ``tolerance`` apart; ``'buffer'`` takes roads that meet the polygon around an edge of the other, whose round ends have two chords a
    quarter circle, and so are a little inside the true distance.

    Roads of one geometry are tested once; the pairs of their numbers are made from arrays of these at the very end, where nothing is
    shuffled or gathered any more.
    """
    alike = cut(unlike(roads))
    pairs = intersections_unlike(alike, tolerance, tolerance_mode, side, dense)
    held = cut(members(roads, alike))
    of = lambda s: held.select(F.col("like").alias(f"like_{s}"), F.col("nth").alias(f"nth_{s}"), F.col("own").alias(f"own_{s}"))
    itself = _itself(alike, tolerance, tolerance_mode).select(F.col("road_uid").alias("like_a"), F.col("road_uid").alias("like_b"))
    both = pairs.toDF("like_a", "like_b").join(of("a"), "like_a").join(of("b"), "like_b")
    inside = itself.join(of("a"), "like_a").join(of("b"), "like_b").where("nth_a <= nth_b and not (nth_a = nth_b and size(own_a) = 1)")
    one = both.select("own_a", F.explode("own_b").alias("b")).select(F.explode("own_a").alias("a"), "b").where("a <> b")
    # within a deal each two come once, by their order; numbers of two deals differ
    two = inside.select("nth_a", "nth_b", "own_a", F.explode("own_b").alias("b")).select("nth_a", "nth_b", F.explode("own_a").alias("a"), "b").where("nth_a < nth_b or a < b").select("a", "b")
    out = one.union(two).select(F.least("a", "b").alias("uid_a"), F.greatest("a", "b").alias("uid_b"))
    return out.distinct() if _repeated(roads) else out


def _repeated(roads: DataFrame) -> bool:
    """Whether a number stands for several geometries."""
    many = roads.where("parts is not null").groupBy("road_uid").agg(F.countDistinct("parts").alias("n")).where("n > 1 and road_uid is not null")
    return not many.isEmpty()


def _itself(alike: DataFrame, tolerance: float, mode: str) -> DataFrame:
    """Roads that meet their equals: all but those without a valid edge."""
    twice = edges(alike).select("road_uid", *(F.struct(*_EDGE[1:]).alias(k) for k in "pq"))
    return twice.where(_near(0.0 if mode == "compat" else tolerance, mode)).select("road_uid").distinct()


def counted(roads: DataFrame, tolerance: float = 0.0, tolerance_mode: str = "compat") -> DataFrame:
    """``uid_a <= uid_b`` of roads of :func:`unlike`, and ``pairs``: how many rows of :func:`intersections` are of roads equal to these two."""
    alike = cut(unlike(roads))
    many = cut(roads.select("road_uid", "parts").distinct().join(alike.select(F.col("road_uid").alias("like"), "parts"), "parts").groupBy("like").agg(F.count(F.lit(1)).alias("n")))
    of = lambda s: many.select(F.col("like").alias(f"uid_{s}"), F.col("n").alias(f"n_{s}"))
    both = intersections_unlike(alike, tolerance, tolerance_mode).join(of("a"), "uid_a").join(of("b"), "uid_b").select("uid_a", "uid_b", (F.col("n_a") * F.col("n_b")).alias("pairs"))
    own = _itself(alike, tolerance, tolerance_mode).join(many, F.col("road_uid") == F.col("like")).where("n > 1")
    return both.union(own.select(F.col("like").alias("uid_a"), F.col("like").alias("uid_b"), F.expr("n * (n - 1) div 2").alias("pairs")))


def adjacency(pairs: DataFrame, distinct: bool = True) -> DataFrame:
    """Both directions of each pair. ``distinct=False``: each comes once already, as :func:`intersections` gives them, so none is looked for twice."""
    if not distinct:
        ways = F.array(F.struct("uid_a", "uid_b"), F.struct(F.col("uid_b").alias("uid_a"), F.col("uid_a").alias("uid_b")))
        return pairs.select(F.inline(ways))
    return pairs.select("uid_a", "uid_b").union(pairs.select(F.col("uid_b").alias("uid_a"), F.col("uid_a").alias("uid_b"))).where("uid_a <> uid_b").distinct()


def neighbour_lists(roads: DataFrame, adjacent: DataFrame) -> DataFrame:
    """``road_uid, neighbours``: every road has a row, isolated ones an empty list."""
    lists = adjacent.groupBy(F.col("uid_a").alias("road_uid")).agg(F.array_sort(F.collect_set("uid_b")).alias("neighbours"))
    return roads.select("road_uid").join(lists, "road_uid", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>")))


def _reached(adjacent: DataFrame) -> DataFrame:
    """``uid_p < uid_q`` of different roads that are adjacent or have a common neighbour, each once.

    Roads ``uid_p`` are dealt into blocks. A road sends its neighbours, in arrays, to the blocks of these; pairs are made, and freed of
    repeats, where they arrive, so that pairs are never shuffled.
    """
    known = adjacent.select(F.col("uid_a").alias("via"), F.col("uid_b").alias("uid"))
    blocks = spread(adjacent.sparkSession, adjacent.select("uid_a").distinct().count())
    block = lambda uid: F.pmod(F.xxhash64(uid), F.lit(blocks)).cast("int").alias("block")
    dealt_out = known.join(known.groupBy("via").agg(F.count(F.lit(1)).alias("n")), "via")
    deal = lambda size: F.pmod(F.xxhash64(F.lit(1), F.col("uid")), F.ceil(F.col("n") / size)).alias("nth")
    own = dealt_out.groupBy("via", block("uid"), deal(DEAL * blocks)).agg(F.collect_list("uid").alias("own"))
    lists = dealt_out.groupBy("via", deal(DEAL)).agg(F.collect_list("uid").alias("others"))
    met = own.join(lists, "via").select("block", "own", "others").union(lists.select(block("via"), F.array("via"), "others"))
    pairs = met.repartitionById(blocks, "block").select("block", F.explode("own").alias("uid_p"), "others")
    pairs = pairs.select("block", "uid_p", F.explode("others").alias("uid_q")).where("uid_p < uid_q")
    return pairs.distinct().select("uid_p", "uid_q")  # of one block each, so where they are


def reach(roads: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Pairs (``uid_p``, ``uid_q``) of the same road, of adjacent ones, and of roads with a common neighbour."""
    same = roads.select("road_uid").union(adjacent.select("uid_a")).distinct().select(F.col("road_uid").alias("uid_p"), F.col("road_uid").alias("uid_q"))
    ways = F.array(F.struct("uid_p", "uid_q"), F.struct(F.col("uid_q").alias("uid_p"), F.col("uid_p").alias("uid_q")))
    return same.union(_reached(adjacent).select(F.inline(ways)))


def reach_of(roads: DataFrame) -> DataFrame:
    """:func:`reach` of ``roads`` by where they intersect.

    What roads of one geometry reach is found once. The pairs of their numbers are made from arrays of these at the very end, where nothing is
    shuffled or gathered any more; the arrays of up to ``SENT`` roads are sent to all tasks.
    """
    if _repeated(roads):
        return reach(roads, cut(adjacency(intersections(roads))))
    alike = cut(unlike(roads))
    adjacent = cut(adjacency(intersections_unlike(alike), distinct=False))
    held = cut(members(roads.where("road_uid is not null"), alike))
    few = (held.agg(F.sum(F.size("own"))).first()[0] or 0) <= SENT
    of = lambda s: (F.broadcast if few else lambda rows: rows)(held.select(F.col("like").alias(f"uid_{s}"), F.col("own").alias(f"own_{s}")))
    # roads that meet their equals reach these, as do those that meet any other
    meeting = _itself(alike, 0.0, "compat").union(adjacent.select("uid_a")).distinct().select(F.col("road_uid").alias("uid_p"), F.col("road_uid").alias("uid_q"))
    across = _reached(adjacent).join(of("p"), "uid_p").join(of("q"), "uid_q")
    both = F.array(F.struct(F.col("own_p").alias("own"), F.col("own_q").alias("others")), F.struct(F.col("own_q").alias("own"), F.col("own_p").alias("others")))
    pairs = across.select(F.inline(both)).union(meeting.join(of("p"), "uid_p").join(of("q"), "uid_q").select("own_p", "own_q"))
    pairs = pairs.select(F.explode("own").alias("uid_p"), "others").select("uid_p", F.explode("others").alias("uid_q")).where("uid_p <> uid_q")
    return roads.select(F.col("road_uid").alias("uid_p"), F.col("road_uid").alias("uid_q")).distinct().union(pairs)


def _meeting_heavy(pairs: DataFrame, adjacent: DataFrame, heavy: DataFrame) -> DataFrame:
    """Those ``pairs`` (``uid_p, uid_q``) of heavy roads that have a common neighbour: their bitmaps meet in some run of numbers."""
    of_heavy = adjacent.join(heavy.select(F.col("uid").alias("uid_a")), "uid_a", "left_semi")
    maps = cut(of_heavy.groupBy(F.col("uid_a").alias("uid"), F.bitmap_bucket_number("uid_b").alias("run")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("uid_b")).alias("map")))
    both = pairs.join(maps, F.col("uid_p") == F.col("uid")).drop("uid").union(pairs.join(maps, F.col("uid_q") == F.col("uid")).drop("uid"))
    met = both.groupBy("uid_p", "uid_q", "run").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("map").alias("map"))
    return met.where((F.col("n") == 2) & (F.bitmap_count("map") > 0)).select("uid_p", "uid_q").distinct()


def neighbours(adjacent: DataFrame) -> DataFrame:
    """``uid, degree, list``: how many neighbours every road has that has any, and which, if these are up to ``LISTED``."""
    edges_ = adjacent.select(F.col("uid_a").alias("uid"), "uid_b")
    degree = edges_.groupBy("uid").agg(F.count(F.lit(1)).alias("degree"))
    lists = edges_.join(degree.where(F.col("degree") <= LISTED).select("uid"), "uid", "left_semi").groupBy("uid").agg(F.collect_list("uid_b").alias("list"))
    return cut(degree.join(lists, "uid", "left"))


def linked_pairs(both: DataFrame, adjacent: DataFrame, heavy_from: int = HEAVY, known: DataFrame | None = None) -> DataFrame:
    """Those of the distinct pairs ``both`` (``uid_p, uid_q``) that are adjacent or have a common neighbour.

    Two roads of up to ``LISTED`` neighbours are compared by their lists (``known``, made by :func:`neighbours`). Of the others adjacent pairs are a
    semi-join; else only the lighter road's neighbours are looked up, one row each, and tested for being the other's; two roads of over
    ``heavy_from`` neighbours meet by bitmaps. So only short lists of neighbours stand in rows, and a road with very many crossings costs a
    pair what the other road has.
    """
    known = neighbours(adjacent) if known is None else known
    of = lambda s: known.select(F.col("uid").alias(f"uid_{s}"), F.col("degree").alias(f"degree_{s}"))
    short = known.where("list is not null")
    listed = lambda s: short.select(F.col("uid").alias(f"uid_{s}"), F.col("list").alias(f"list_{s}"))
    out = both.join(listed("p"), "uid_p").join(listed("q"), "uid_q").where(F.array_contains("list_p", F.col("uid_q")) | F.arrays_overlap("list_p", "list_q")).select("uid_p", "uid_q")
    if known.where("list is null").isEmpty():
        return out.distinct()
    edges_ = adjacent.select("uid_a", "uid_b")
    rest = cut(both.join(of("p"), "uid_p").join(of("q"), "uid_q").where(F.greatest("degree_p", "degree_q") > LISTED))  # a road without neighbours has none in common
    direct = rest.select("uid_p", "uid_q").join(edges_.toDF("uid_p", "uid_q"), ["uid_p", "uid_q"], "left_semi")
    rest = rest.join(edges_.toDF("uid_p", "uid_q"), ["uid_p", "uid_q"], "left_anti")
    heavy = known.where(F.col("degree") > heavy_from).select("uid")
    any_heavy = not heavy.isEmpty()
    if any_heavy:
        rest = cut(rest)
    two = F.least("degree_p", "degree_q") > heavy_from
    light = F.when(F.col("degree_p") <= F.col("degree_q"), F.struct(F.col("uid_p").alias("light"), F.col("uid_q").alias("other"))).otherwise(F.struct(F.col("uid_q").alias("light"), F.col("uid_p").alias("other")))
    small = rest.where(~two).select("uid_p", "uid_q", light.alias("l")).select("uid_p", "uid_q", "l.*")
    via = small.join(edges_.toDF("light", "via"), "light").join(edges_.toDF("other", "via"), ["other", "via"], "left_semi")
    out = out.union(direct).union(via.select("uid_p", "uid_q"))
    if any_heavy:
        out = out.union(_meeting_heavy(rest.where(two).select("uid_p", "uid_q"), edges_, heavy))
    return out.distinct()


def allowed_pairs(pairs: DataFrame, adjacent: DataFrame, a: str, b: str, known: DataFrame | None = None) -> DataFrame:
    """Rows of ``pairs`` whose roads ``a`` and ``b`` may hold neighbours: each distinct pair of roads is tested once (:func:`linked_pairs`)."""
    pairs = cut(pairs)
    both = pairs.where(F.col(a) != F.col(b)).select(F.col(a).alias("uid_p"), F.col(b).alias("uid_q")).distinct()
    linked = linked_pairs(both, adjacent, known=known).withColumn("_linked", F.lit(True))
    named = pairs.join(linked, (F.col(a) == F.col("uid_p")) & (F.col(b) == F.col("uid_q")), "left")
    return named.where((F.col(a) == F.col(b)) | F.col("_linked")).select(pairs.columns)
