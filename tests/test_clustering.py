import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from roadloom.functions.geometry import PARTS
from roadloom.operators import associate, clean, closest, components, dbscan, keys, roads, summarize
from roadloom.session import spread


def sequential(points, adjacent, eps, min_pts):
    """Queue-based clustering in order of the points, straight from the definition."""
    links = {}
    for a, b in adjacent:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)

    def allowed(a, b):
        a, b = -999 if a is None else a, -999 if b is None else b
        return a == b or b in links.get(a, ()) or bool(links.get(a, set()) & links.get(b, set()))

    near = [[j for j, q in enumerate(points) if j != i and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps and allowed(p[2], q[2])] for i, p in enumerate(points)]
    label, n = [0] * len(points), 0
    for i in range(len(points)):
        if label[i]:
            continue
        if len(near[i]) < min_pts - 1:
            label[i] = -1
            continue
        n += 1
        label[i] = n
        queue = deque(near[i])
        while queue:
            j = queue.popleft()
            if label[j] == -1:
                label[j] = n
            if label[j]:
                continue
            label[j] = n
            if len(near[j]) >= min_pts - 1:
                queue.extend(near[j])
    return label


def labels(spark, points, adjacent, eps, min_pts, parts=3):
    table = spark.createDataFrame([(k, float(x), float(y), u) for k, (x, y, u) in enumerate(points)], "point_idx long, x double, y double, road_uid long").repartition(parts)
    links = roads.adjacency(spark.createDataFrame([*adjacent], "uid_a long, uid_b long"))
    return [r["cluster"] for r in dbscan.cluster(table, links, eps, min_pts).orderBy("point_idx").collect()]


@pytest.mark.parametrize("seed", range(5))
def test_equals_the_sequential_definition(spark, seed):
    rng = random.Random(seed)
    side, n = rng.choice([12, 25, 40]), rng.randrange(30, 160)
    points = [(rng.randrange(side), rng.randrange(side), rng.choice([0, 1, 2, 3, 4, 5, -999, None])) for _ in range(n)]
    points += [(3, 3, 1)] * rng.randrange(0, 40) + [(9 + k % 2, 9, 2) for k in range(rng.randrange(0, 40))]
    rng.shuffle(points)
    adjacent = [(a, b) for a in range(6) for b in range(a + 1, 6) if rng.random() < 0.3]
    eps, min_pts = rng.choice([1, 2, 3.5, 5]), rng.choice([2, 3, 5, 8])
    assert labels(spark, points, adjacent, eps, min_pts) == sequential(points, adjacent, eps, min_pts)


def test_large_clumps_that_their_corners_do_not_link(spark):
    """A dent on one side and a bump on the other: only inner cores are within reach."""
    eps, points = 10.0, []
    points += [(4.0, 4.9 - abs(k) * 0.2, 1) for k in range(-8, 9)] + [(0.1 + 0.2 * k, 0.1, 1) for k in range(8)]
    points += [(13.9 + abs(k) * 0.05, 4.0 + 0.1 * k, 1) for k in range(-8, 9)]
    for min_pts in (4, 9):
        assert labels(spark, points, [], eps, min_pts) == sequential(points, [], eps, min_pts)


FIXTURES = {
    "coincident": ([(0, 0, 1)] * 6, [], 1, 5),
    "weight": ([(0, 0, 1)] * 9 + [(10, 0, 1)], [], 10, 5),
    "eps_edge": ([(0, 0, 1), (3, 4, 1)], [], 5, 2),
    "parallel": ([(0, 0, 1), (0, 1, 2)], [], 5, 2),
    "one_hop": ([(0, 0, 1), (0, 1, 3)], [(1, 2), (2, 3)], 5, 2),
    "two_hops": ([(0, 0, 1), (0, 1, 4)], [(1, 2), (2, 3), (3, 4)], 5, 2),
    "unassociated": ([(0, 0, None), (0, 1, -999), (0, 2, 1)], [], 5, 2),
    "border_tie": ([(k * 0.1, 0, 1) for k in range(4)] + [(3, 0, 1)] + [(5.9 + k * 0.1, 0, 1) for k in range(4)], [], 3, 5),
}


@pytest.mark.parametrize("name", FIXTURES)
def test_fixtures(spark, name):
    points, adjacent, eps, min_pts = FIXTURES[name]
    assert labels(spark, points, adjacent, eps, min_pts) == sequential(points, adjacent, eps, min_pts)


def test_guards(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 1)], "point_idx long, x double, y double, road_uid long")
    none = spark.createDataFrame([], "uid_a long, uid_b long")
    assert [r["cluster"] for r in dbscan.cluster(points, None, 1, 2).collect()] == [-1]
    assert dbscan.cluster(points.where("false"), none, 1, 2).collect() == []
    with pytest.raises(ValueError):
        dbscan.cluster(points.drop("road_uid"), none, 1, 2)
    for eps, min_pts in ((0, 5), (-1, 5), ("1", 5), (1, 1), (1, 2.5)):
        with pytest.raises(ValueError):
            dbscan.cluster(points, none, eps, min_pts)
    odd = spark.createDataFrame([(0, None, 0.0, 1), (1, float("nan"), 0.0, 1)], "point_idx long, x double, y double, road_uid long")
    assert [r["cluster"] for r in dbscan.cluster(odd, none, 1, 2).collect()] == [-1, -1]


def line_table(spark, lines):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in part] for part in parts]) for k, parts in lines]
    return spark.createDataFrame(rows, f"road_uid long, parts {PARTS}")


def test_slanted_roads_and_nearest(spark):
    rng = random.Random(4)
    lines = [(k, [[(rng.randrange(100), rng.randrange(100)) for _ in range(rng.randrange(2, 5))]]) for k in range(60)]
    lines = [(k, p) for k, p in lines if all(a != b for a, b in zip(p[0][:-1], p[0][1:]))]
    table = line_table(spark, lines)
    from test_functions import touches

    edges = {k: list(zip(p[0][:-1], p[0][1:])) for k, p in lines}
    want = {(a, b) for a in edges for b in edges if a < b and any(touches(p, q) for p in edges[a] for q in edges[b])}
    for side in (None, 7.0, 300.0):
        assert {(r["uid_a"], r["uid_b"]) for r in roads.intersections(table, side=side).collect()} == want

    def d2(p, e):
        (x1, y1), (x2, y2) = e
        t = max(0, min(1, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return (p[0] - x1 - t * (x2 - x1)) ** 2 + (p[1] - y1 - t * (y2 - y1)) ** 2

    points = [(k, rng.randrange(-50, 400), rng.randrange(-50, 150)) for k in range(200)]
    near = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in points], "point_idx long, x double, y double")
    for side in (None, 2.0):
        got = {r["point_idx"]: (r["road_uid"], r["d2"]) for r in associate.nearest(near, table, side).collect()}
        for k, x, y in points:
            best = min(d2((x, y), e) for es in edges.values() for e in es)
            assert got[k][1] == pytest.approx(best, abs=1e-9)
            assert min(d2((x, y), e) for e in edges[got[k][0]]) == pytest.approx(best, abs=1e-9)


def test_multi_part_roads_and_empty_inputs(spark):
    table = line_table(spark, [(0, [[(0, 0), (2, 2)], [(0, 2), (2, 0)]]), (1, [[(5, 5), (6, 6)]])])
    assert roads.intersections(table).collect() == []
    points = spark.createDataFrame([(0, 1.0, 1.0)], "point_idx long, x double, y double")
    assert [(r["road_uid"], r["dist_to_road"]) for r in associate.associate(points, table.where("false")).collect()] == [(-999, None)]
    assert [(r["road_uid"], r["dist_to_road"]) for r in associate.associate(points, table).collect()] == [(0, 0.0)]
    with pytest.raises(ValueError):
        roads.intersections(table, -1)
    with pytest.raises(ValueError):
        roads.intersections(table, 1, "other")


def test_cleaning(spark):
    raw = spark.createDataFrame([(k, [[{"x": 0.0, "y": 0.0}, {"x": float(k % 2), "y": 0.0}]]) for k in range(4)], f"record_no long, parts {PARTS}")
    with pytest.raises(clean.LayerError):
        clean.clean_roads(raw)
    assert sorted(r["road_uid"] for r in clean.clean_roads(raw, on_invalid="drop").collect()) == [1, 3]
    with pytest.raises(clean.LayerError):
        clean.clean_roads(raw.withColumn("road_uid", F.lit(1)))
    with pytest.raises(clean.LayerError):
        clean.clean_points(spark.range(1))
    assert clean.merge_uid(spark.range(1)).columns == ["id", "road_uid"]
    assert clean.merge_uid(spark.range(1).withColumns({"road_uid": F.lit(1), "road_uid_road": F.lit(2)})).first()["road_uid"] == 2
    texts = spark.createDataFrame([("5",), ("5.7",), ("x",), (None,), ("1e30",)], "v string")
    assert [r[0] for r in texts.select(clean.to_key(F.col("v"))).collect()] == [5, 5, -999, -999, -999]


def test_dense_index(spark):
    table = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [r["i"] for r in keys.dense_index(table, ["k"], "i", 1).orderBy("k").collect()] == list(range(1, 1001))


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_a_path_and_a_hub(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (7, None), (3000, 2000)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[1000 + k] == 1000 for k in range(300)) and got[3000] == got[2000] == 2000
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def smallest(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("few,chunk", [(0, 37), (60, 37), (60, 500), (10_000, 10)])
def test_components_by_forests_of_chunks(spark, monkeypatch, few, chunk):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(few + chunk)
    node = rng.sample(range(5000), 900)
    edges = [(k, k + 1) for k in range(10_000, 10_400)] + [(node[k], node[k + 1]) for k in range(300)] + [tuple(rng.sample(node[301:], 2)) for _ in range(400)] + [(20_000, k) for k in range(20_001, 20_150)]

    def chunked(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, chunk):
                yield from original(iter([batch.slice(k, chunk)]))

    original = components._forest
    monkeypatch.setattr(components, "_forest", chunked)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == smallest(edges)


def test_forests_leave_few_edges_of_a_long_path(spark):
    n = 1_000_000
    path = spark.range(n).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    least, left = components.shrunk(path)
    assert left.count() < 100 and least.count() == n


def closest_brute(a, b, reach):
    return any((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= reach * reach for p in a for q in b)


@pytest.mark.parametrize("seed", range(3))
def test_touching_groups_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(closest, "LEAF", 6)
    rng = random.Random(seed)
    side, groups = 8.0, {}
    for k in range(12):
        ox, oy = rng.randrange(3) * side, rng.randrange(3) * side
        groups[k] = [(ox + rng.random() * 7.9, oy + rng.random() * 7.9) for _ in range(rng.randrange(1, 40))]
    groups[12], groups[13] = [(0.5, y / 8) for y in range(60)], [(16.5 + 1e-9 * (seed == 1), y / 8) for y in range(60)]  # 16 apart, or just over
    points = spark.createDataFrame([(k, x, y) for k, v in groups.items() for x, y in v], "group long, x double, y double")
    pairs = [(a, b) for a in groups for b in groups if a < b]
    found = closest.touching(spark.createDataFrame(pairs, "a long, b long"), points, 16.0, side)
    assert {tuple(r) for r in found.collect()} == {(a, b) for a, b in pairs if closest_brute(groups[a], groups[b], 16.0)}


def test_two_large_groups_that_face_each_other_are_not_compared_point_by_point(spark):
    n, reach = 100_000, 50.0
    across = lambda g, x: spark.range(n).select(F.lit(g).cast("long").alias("group"), (x - 24.9 * F.rand(g)).alias("x"), (24.9 * F.rand(g + 5)).alias("y"))
    points = across(1, 24.9).union(across(2, 99.95)).cache()  # gap 50.15
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    settled, work = 0, 0
    for linked, leaves, _ in closest.levels(pairs, points, reach, 25.0):
        settled += linked.count()
        work += leaves.agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0
    assert settled == 0 and work < n
    assert closest.touching(pairs, points, reach, 25.0).count() == 0 and closest.touching(pairs, points, 50.5, 25.0).count() == 1


def test_a_cell_with_half_of_all_edges_is_split(spark):
    rng = random.Random(8)
    rows = [(k, [[(x := 500 + rng.random() * 8, y := 500 + rng.random() * 8), (x + rng.random(), y + rng.random())]]) for k in range(1500)]
    rows += [(1500 + k, [[(x := rng.random() * 4000, y := rng.random() * 4000), (x + 30 * rng.random(), y + 30)]]) for k in range(1500)]
    lines = line_table(spark, rows)
    held = roads.edges(lines)
    start = held.withColumn("cell", F.explode(roads.cells_of_edge(60.0))).groupBy("cell").count().agg(F.max("count")).first()[0]
    leaf = roads.leaves(held, 60.0, dense=64)
    sizes = [r["count"] for r in leaf.groupBy("level", "cx", "cy").count().collect()]
    dealt = roads.dealt(leaf, 64).groupBy("level", "cx", "cy", "low", "high").count().agg(F.max("count")).first()[0]
    assert start > 1000 and max(sizes) < 200 and dealt <= 150
    assert {tuple(r) for r in roads.intersections(lines, side=60.0, dense=64).collect()} == {tuple(r) for r in roads.intersections(lines, side=2.0, dense=10**6).collect()}


def test_very_many_roads_through_one_point_are_dealt_into_blocks(spark):
    lines = line_table(spark, [(k, [[(-50.0 + k, -50.0 * (1 + k % 7)), (50.0 - k, 50.0 * (1 + k % 7))]]) for k in range(-40, 41)])
    leaf = roads.leaves(roads.edges(lines), 40.0, dense=8)
    assert leaf.where("n > 8").count() > 0
    groups = roads.dealt(leaf, 8).groupBy("level", "cx", "cy", "low", "high").count()
    assert groups.agg(F.max("count")).first()[0] <= 40
    assert roads.intersections(lines, side=40.0, dense=8).count() == 81 * 80 // 2


@pytest.mark.parametrize("heavy", [2, 10**6])
def test_linked_pairs_of_hubs(spark, heavy):
    rng = random.Random(heavy)
    hub = [(0, k) for k in range(5, 400)] + [(1, k) for k in range(390, 70_000, 97)] + [(2, k) for k in range(401, 500)] + [(k, k + 1) for k in range(600, 700)] + [(3, 69_993), (-5, 4)]
    adjacent = roads.adjacency(spark.createDataFrame(hub, "uid_a long, uid_b long"))
    near = {}
    for a, b in hub:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    every = [*range(12), -5, *(rng.randrange(70_000) for _ in range(60)), 601, 602, 603, 610]
    pairs = {(a, b) for a in every for b in every if a != b}
    want = {(a, b) for a, b in pairs if b in near.get(a, ()) or near.get(a, set()) & near.get(b, set())}
    got = {tuple(r) for r in roads.linked_pairs(spark.createDataFrame(list(pairs), "uid_p long, uid_q long"), adjacent, heavy).collect()}
    assert got == want and (0, 1) in want and (0, 2) not in want


def test_far_points_cost_no_more_jobs(spark):
    lines = line_table(spark, [(k, [[(10.0 * k, 0.0), (10.0 * k + 9, 3.0)]]) for k in range(20)])

    def jobs(far):
        points = spark.createDataFrame([(k, 10.0 * k, 1.0) for k in range(20)] + [(100, far, far), (101, -far, 2.0)], "point_idx long, x double, y double")
        spark.sparkContext.setJobGroup(f"far{far}", "")
        rows = {r["point_idx"]: r["road_uid"] for r in associate.nearest(points, lines, 16.0).collect()}
        count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"far{far}"))
        spark.sparkContext.setJobGroup("other", "")
        assert rows[100] == (19 if far > 1000 else 9) and rows[101] == 0 and len(rows) == 22
        return count

    assert jobs(2.0**28) <= jobs(100.0) + 2  # 26 levels against 4


def octagon(p, q, tolerance):
    """Whether the polygon around edge p, vertex by vertex, meets edge q."""
    import math

    (x1, y1), (x2, y2) = p
    turn = math.atan2(y2 - y1, x2 - x1) if p[0] != p[1] else 0.0
    ring = [(x2 + tolerance * math.cos(turn + math.radians(d)), y2 + tolerance * math.sin(turn + math.radians(d))) for d in (-90, -45, 0, 45, 90)]
    ring += [(x1 + tolerance * math.cos(turn + math.radians(d)), y1 + tolerance * math.sin(turn + math.radians(d))) for d in (90, 135, 180, 225, 270)]
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    sides = list(zip(ring, ring[1:] + ring[:1]))
    if any(all(cross(a, b, v) >= -1e-9 for a, b in sides) for v in q):
        return True
    return any(cross(a, b, q[0]) * cross(a, b, q[1]) <= 0 and cross(*q, a) * cross(*q, b) <= 0 for a, b in sides if a != b)


def test_buffer_mode_follows_the_polygon(spark):
    rng = random.Random(12)
    lines = [[(rng.random() * 60, rng.random() * 60) for _ in range(2)] for _ in range(40)] + [[(5.0, 5.0), (20.0, 5.0)], [(20.0 + 9.8 * 0.92, 5 + 9.8 * 0.39), (60.0, 60.0)]]
    table = line_table(spark, [(k, [v]) for k, v in enumerate(lines)])
    got = {tuple(r) for r in roads.intersections(table, 10.0, "buffer", side=15.0).collect()}
    want = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if octagon(lines[a], lines[b], 10.0) or octagon(lines[b], lines[a], 10.0)}
    assert got == want
    true = {tuple(r) for r in roads.intersections(table, 10.0, "effective", side=15.0).collect()}
    assert got < true and (40, 41) in true - got


def labelled(spark, rows):
    return spark.createDataFrame([(float(x), float(y), c) for x, y, c in rows], "x double, y double, cluster long").repartition(3)


def test_summary_of_degenerate_clusters(spark):
    rows = [(0, 0, 1)] * 9 + [(10, 0, 1)] + [(5, 5, 2)] * 6 + [(k, 2 * k, 3) for k in range(5)] + [(0, 0, 4), (4, 0, 4), (0, 3, 4), (1, 1, 4), (0, 0, 4)] + [(9, 9, -1), (0, 0, 0)]
    got = {r["Cluster_ID"]: tuple(r)[1:] for r in summarize.summary(labelled(spark, rows)).collect()}
    assert got == {1: (10, 5.0, 0.0, None), 2: (6, 5.0, 5.0, None), 3: (5, 2.0, 4.0, None), 4: (5, 1.25, 1.0, 6.0)}
    counts = summarize.run_counts(labelled(spark, rows)).first().asDict()
    assert counts == {"points": 28, "clusters": 4, "noise": 1, "clustered": 26, "unclassified": 1}
    assert [r["Cluster_ID"] for r in summarize.ordered(summarize.summary(labelled(spark, rows))).collect()] == [1, 2, 3, 4]


def test_hulls_far_from_the_origin(spark):
    rng = random.Random(6)
    rows = [(630_000 + rng.randrange(1000), 2_490_000 + rng.randrange(1000), c) for c in (1, 2, 3) for _ in range(40)]
    got = {r["cluster"]: r["area"] for r in summarize.hulls(labelled(spark, rows)).collect()}
    for c in (1, 2, 3):
        ring = summarize.convex_ring([(x, y) for x, y, k in rows if k == c])
        twice = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))
        assert got[c] == twice / 2
        assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(ring, ring[1:] + ring[:1]) for x, y, k in rows if k == c)


def turning(points):
    """Corners by trying every direction: those that are farther out than all others somewhere."""
    distinct = sorted(set(points))
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    sides = {(p, q) for p in distinct for q in distinct if p != q and all(cross(p, q, r) > 0 or cross(p, q, r) == 0 and min(p, q) <= r <= max(p, q) for r in distinct)}
    return {p for side in sides for p in side}


@pytest.mark.parametrize("seed", range(6))
def test_hull_corners_equal_brute_force(seed):
    rng = random.Random(seed)
    points = [(float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(rng.randrange(3, 60))]
    ring, want = summarize.convex_ring(points), turning(points)
    if len(ring) > 2:
        assert set(ring) == want and len(ring) == len(want) and ring[0] == min(points)


def test_hulls_of_large_and_odd_clusters(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("cluster"), F.cos(F.col("id")).alias("a"), F.col("id").alias("k"))
    disc = rows.select("cluster", (1e6 + 1000 * F.sqrt(F.rand(3)) * F.cos(F.col("k") / 7)).alias("x"), (2e6 + 1000 * F.sqrt(F.rand(3)) * F.sin(F.col("k") / 7)).alias("y"))
    arc = spark.range(5000).select(F.lit(2).alias("cluster"), F.cos(F.col("id") * 3.14159 / 5000).alias("x"), F.sin(F.col("id") * 3.14159 / 5000).alias("y"))
    bay = spark.range(5000).select(F.lit(3).alias("cluster"), F.cos(F.col("id") * 3.14159 / 5000).alias("x"), (-F.sin(F.col("id") * 3.14159 / 5000)).alias("y"))
    line = spark.range(50).select(F.lit(4).alias("cluster"), (F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0).alias("y"))
    one = spark.range(50).select(F.lit(5).alias("cluster"), F.lit(3.0).alias("x"), F.lit(3.0).alias("y"))
    every = disc.union(arc).union(bay).union(line).union(one).cache()
    found = {r["cluster"]: r for r in summarize.hulls(every.repartition(6)).collect()}
    assert set(found) == {1, 2, 3} and abs(found[1]["area"] / (3.14159265 * 1e6) - 1) < 0.002
    assert len(found[2]["ring"]) == len(found[3]["ring"]) == 5001 and abs(found[2]["area"] - 1.5708) < 1e-3
    assert summarize.outermost(every.select("cluster", "x", "y")).where("cluster = 1").count() < 30_000


def test_roads_of_one_geometry_are_compared_once(spark, monkeypatch):
    lines = [[[(0.0, 0.0), (10.0, 0.0)]], [[(5.0, -5.0), (5.0, 5.0)]], [[(0.0, 9.0), (10.0, 9.0)]]]
    many = [(3 * n + k, line) for n in range(700) for k, line in enumerate(lines)]
    table = spark.createDataFrame(many, f"road_uid long, parts {PARTS}")
    seen = []
    monkeypatch.setattr(roads, "leaves", lambda rows, *a, f=roads.leaves: (seen.append(rows.count()), f(rows, *a))[1])
    want = {(a, b) for a in range(2100) for b in range(a + 1, 2100) if a % 3 == b % 3 or {a % 3, b % 3} == {0, 1}}
    pairs = roads.intersections(table)
    assert pairs.count() == len(want) and {tuple(r) for r in pairs.collect()} == want
    assert roads.adjacency(pairs, distinct=False).count() == 2 * len(want)
    assert seen == [3]


def test_nearest_looks_at_equal_edges_and_places_once(spark, monkeypatch):
    many = spark.createDataFrame([(n, [[(0.0, 0.0), (10.0, 0.0)]]) for n in range(50, 0, -1)], f"road_uid long, parts {PARTS}")
    points = spark.createDataFrame([(n, float(n % 4), 2.0) for n in range(100)], "point_idx long, x double, y double")
    seen = []
    monkeypatch.setattr(associate, "edge_index", lambda rows, *a, f=associate.edge_index: (seen.append(rows.count()), f(rows, *a))[1])
    assert {tuple(r) for r in associate.nearest(points, many).collect()} == {(n, 1, 4.0) for n in range(100)}
    assert seen == [1]


def test_thin_clumps_in_a_crowd_are_not_compared_point_by_point(spark, monkeypatch):
    rng = random.Random(5)
    placed = [(n, rng.uniform(0, 300), rng.uniform(0, 300), rng.randrange(60)) for n in range(1500)]  # about one point of a road in a cell
    adjacent = spark.createDataFrame([(a, b) for a in range(60) for b in range(60) if a != b], "uid_a long, uid_b long")
    points = spark.createDataFrame(placed, "point_idx long, x double, y double, road_uid long")
    sizes = []
    monkeypatch.setattr(dbscan, "cut", lambda rows, f=dbscan.cut: (held := f(rows), sizes.append(held.count() if "other_clump" in held.columns else 0))[0])
    got = {r["point_idx"]: r["cluster"] for r in dbscan.cluster(points, adjacent, 60.0, 5).collect()}
    assert set(got.values()) == {1} and len(got) == 1500
    assert max(sizes) < 1500


def test_dense_clumps_on_meeting_roads_need_no_pairs(spark, monkeypatch):
    """Twenty roads each way cross in every cell; all clumps are joined by the roads that meet, so no pairs of others are looked at."""
    lines = [(2 * k, [[(0.0, 2.0 * k), (100.0, 2.0 * k)]]) for k in range(20)] + [(2 * k + 1, [[(2.0 * k, 0.0), (2.0 * k, 100.0)]]) for k in range(20)]
    table = spark.createDataFrame(lines, "road_uid long, parts array<array<struct<x: double, y: double>>>")
    adjacent = roads.adjacency(roads.intersections(table)).localCheckpoint()
    rows = [(100 * uid + 10 * k + j, x + (5.0 * k if uid % 2 == 0 else 0.0), y + (5.0 * k if uid % 2 else 0.0), uid) for uid, [[(x, y), _]] in lines for k in range(8) for j in range(5)]
    points = spark.createDataFrame(rows, "point_idx long, x double, y double, road_uid long")
    seen, real = [], dbscan.allowed_pairs
    monkeypatch.setattr(dbscan, "allowed_pairs", lambda pairs, *rest: (seen.append(pairs.count()), real(pairs, *rest))[1])
    got = dbscan.cluster(points, adjacent, 30.0, 5).groupBy("cluster", "core").count().collect()
    assert [tuple(r) for r in got] == [(1, True, len(rows))]
    assert sum(seen) == 0


def test_places_that_are_not_sent_find_the_same_roads(spark, monkeypatch):
    table = spark.createDataFrame([(k, [[(10.0 * k, 0.0), (10.0 * k, 5.0)]]) for k in range(9)], "road_uid long, parts array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(k, float(k * k), float(k % 7 * 40)) for k in range(60)], "point_idx long, x double, y double")
    answers = []
    for most in (associate.SENT, 0):
        monkeypatch.setattr(associate, "SENT", most)
        answers.append({r["point_idx"]: (r["road_uid"], r["dist_to_road"]) for r in associate.associate(points, table, 4.0).collect()})
    want = {r["point_idx"]: min((((r["x"] - 10 * k) ** 2 + max(0.0, r["y"] - 5) ** 2) ** 0.5, k) for k in range(9)) for r in points.collect()}
    assert answers[0] == answers[1] and {k: v[0] for k, v in answers[0].items()} == {k: v[1] for k, v in want.items()}
    assert {k: v[1] for k, v in answers[0].items()} == pytest.approx({k: v[0] for k, v in want.items()})


def test_points_in_dense_clumps_are_gathered_by_clumps_only(spark, monkeypatch):
    """Where every clump is sure, no sites are made and no table on the way has a row for each place."""
    points = spark.createDataFrame([(n, n % 40 / 2, n // 40 % 20 / 10, n % 3) for n in range(2400)], "point_idx long, x double, y double, road_uid long")
    adjacent = spark.createDataFrame([(0, 1), (1, 0)], "uid_a long, uid_b long")
    sizes = []
    monkeypatch.setattr(dbscan, "cut", lambda rows, f=dbscan.cut: (held := f(rows), sizes.append(held.count()))[0])
    got = {r["point_idx"]: (r["core"], r["cluster"]) for r in dbscan.cluster(points, adjacent, 20.0, 5).collect()}
    assert got == {n: (True, 2 if n % 3 == 2 else 1) for n in range(2400)}
    assert max(sizes) <= 6  # 2 cells, 3 roads


def test_cells_of_high_levels_are_looked_up_once(spark, monkeypatch):
    """Places without a road near them ask which cells hold any, not for each road in these."""
    table = spark.createDataFrame([(k, [[(float(k), 0.0), (k + 1.0, 0.0)]]) for k in range(300)], f"road_uid long, parts {PARTS}")
    points = spark.createDataFrame([(k, 40.0 * (k % 20), 500.0 + 40 * (k // 20)) for k in range(200)], "point_idx long, x double, y double")
    seen, real = [], associate.sent
    monkeypatch.setattr(associate, "sent", lambda rows: (seen.append(sorted(rows.columns)), real(rows))[1])
    met, join = [], type(points).join
    monkeypatch.setattr(type(points), "join", lambda self, other, *a, **k: (met.append(self.count()) if sorted(self.columns) == ["cx", "cy", "level"] else None, join(self, other, *a, **k))[1])
    got = {r["point_idx"]: r["road_uid"] for r in associate.nearest(points, table, 2.0).collect()}
    assert got == {k: min(max(40 * (k % 20) - 1, 0), 299) for k in range(200)}
    assert seen and met and max(met) <= 500  # 300 roads at five levels or more are over 2,000 rows


def test_few_rows_are_spread_over_the_cores_only(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        cores = 4 * spark.sparkContext.defaultParallelism
        assert (spread(spark), spread(spark, 8000), spread(spark, 10**6)) == (max(200, cores), cores, max(200, cores))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_first_cells_of_dense_edges_are_small_enough(spark):
    lines = line_table(spark, [(k, [[(float(7 * k % 200), float(11 * k % 200)), (7 * k % 200 + 100.0, float(11 * k % 200))]]) for k in range(2000)])
    held = roads.edges(lines)
    side = roads.cell_size(held)
    assert 100 / 16 <= side < 200 and roads.cell_size(held.limit(20)) == 200.0


def shuffled(spark):
    """Bytes that the session's tasks have written for shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    held = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(held.apply(k).totalShuffleWrite() for k in range(held.size()))


@pytest.mark.parametrize("odd", [False, True])
def test_reach_equals_brute_force(spark, monkeypatch, odd):
    """Equal roads, one without a length or parts, a hub; with ``odd`` also a number of two geometries."""
    rng = random.Random(7)
    lines = [[[(float(x), float(y)), (x + 6.0 * (k % 2), y + 6.0 * (1 - k % 2))]] for k in range(40) for x, y in [(rng.randrange(30), rng.randrange(30))]]
    rows = [(3 * n + 1, lines[n % 40]) for n in range(90)] + [(500, [[(0.0, 0.0), (30.0, 30.0)]]), (501, [[(90.0, 9.0), (90.0, 9.0)]]), (502, [[(90.0, 9.0), (90.0, 9.0)]]), (503, []), (504, []), (505, [])]
    rows += [(1, lines[25]), (4, [[(200.0, 0.0), (201.0, 0.0)]]), (506, [[(200.5, -1.0), (200.5, 1.0)]])] if odd else [(1, lines[0])]
    table = line_table(spark, rows).withColumn("parts", F.when(F.col("road_uid") != 503, F.col("parts")))
    near = {}
    for a, b in roads.intersections(table).collect():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    numbers = {n for n, _ in rows}
    want = sorted((a, b) for a in numbers for b in numbers if a == b or b in near.get(a, ()) or near.get(a, set()) & near.get(b, set()))
    adjacent = roads.adjacency(roads.intersections(table))
    for deal, most in ((roads.DEAL, roads.SENT), (3, 0)):  # arrays of three, none of them sent
        monkeypatch.setattr(roads, "DEAL", deal)
        monkeypatch.setattr(roads, "SENT", most)
        assert sorted(tuple(r) for r in roads.reach_of(table).collect()) == want
        assert sorted(tuple(r) for r in roads.reach(table, adjacent).collect()) == want


def test_reach_shuffles_no_pairs(spark):
    """Two geometries of 300 roads: 360,000 pairs by 600 ways each."""
    table = line_table(spark, [(n, [[(0.0, 0.0), (9.0, 0.0)]] if n % 2 else [[(5.0, -5.0), (5.0, 5.0)]]) for n in range(600)])
    before = shuffled(spark)
    assert roads.reach_of(table).count() == 600 * 600
    assert shuffled(spark) - before < 200_000


@pytest.mark.parametrize("seed", range(3))
def test_constrained_pairs_equal_brute_force(spark, monkeypatch, seed):
    """Crowded places, roads that cross, points without a road or place; arrays and groups of a few points in the last run."""
    rng = random.Random(seed)
    places = [(rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0, 1, 2, 3, 4, 80, 90, -999, None])) for _ in range(90)] + [(5.0, 5.0, 1)] * 9 + [(5.0, -5.0, 2), (12.0, -5.0, 2), (10.0, 5.0, 1)]
    placed = [(2 * k + 7, *p) for k, p in enumerate(places)] + [(1, None, 0.0, 1), (2, float("nan"), 0.0, 1), (None, 0.0, 0.0, 1), (7, 1.0, 1.0, 1)]  # a number that comes twice
    adjacent = [(a, b) for a, b in [(0, 1), (1, 2), (3, 4), (4, 80), (2, 90)] if rng.random() < 0.9]
    links = {}
    for a, b in adjacent:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    eps, uid = 7.0, lambda u: -999 if u is None else u
    held = [(n, x, y, uid(u)) for n, x, y, u in placed if n is not None and x is not None and x == x]
    allowed = lambda a, b: a == b or b in links.get(a, ()) or bool(links.get(a, set()) & links.get(b, set()))
    want = sorted((p[0], q[0], p[3], q[3]) for p in held for q in held if p[0] < q[0] and (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= eps * eps and allowed(p[3], q[3]))
    table = spark.createDataFrame(placed, "point_idx long, x double, y double, road_uid long").repartition(3)
    graph = roads.adjacency(spark.createDataFrame(adjacent, "uid_a long, uid_b long"))
    for sizes in ((dbscan.HELD, dbscan.PLACED, dbscan.GROUP), (2, 4, 5)):
        for name, size in zip(("HELD", "PLACED", "GROUP"), sizes):
            monkeypatch.setattr(dbscan, name, size)
        assert sorted(tuple(r) for r in dbscan.constrained_pairs(table, graph, eps).select("i", "j", "uid_i", "uid_j").collect()) == want


def test_roads_of_a_crowded_cell_pair_by_their_places_there(spark):
    """Over 64 roads in a cell: their places don't fit one word."""
    points = spark.createDataFrame([(k, k % 10 / 10, k // 10 / 100, k) for k in range(300)], "point_idx long, x double, y double, road_uid long")
    adjacent = roads.adjacency(spark.createDataFrame([(k, k + 150) for k in range(150)], "uid_a long, uid_b long"))
    assert sorted(tuple(r) for r in dbscan.constrained_pairs(points, adjacent, 9.0).select("i", "j").collect()) == [(k, k + 150) for k in range(150)]


def test_pairs_of_points_are_neither_kept_nor_shuffled(spark, monkeypatch):
    """Two million pairs of 2,000 points."""
    points = spark.createDataFrame([(n, n % 50 / 2, n // 50 / 2, n % 2) for n in range(2000)], "point_idx long, x double, y double, road_uid long")
    adjacent = spark.createDataFrame([(0, 1), (1, 0)], "uid_a long, uid_b long")
    sizes = []
    for place in (dbscan, roads):
        monkeypatch.setattr(place, "cut", lambda rows, f=place.cut: (held := f(rows), sizes.append(held.count()))[0])
    before = shuffled(spark)
    assert dbscan.constrained_pairs(points, adjacent, 60.0).count() == 2000 * 1999 // 2
    assert max(sizes) < 2000 and shuffled(spark) - before < 500_000


def test_unassociated_pairs_are_the_constrained_pairs_without_a_road(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(n, rng.uniform(0, 40), rng.uniform(0, 40), rng.choice([None, -999, 1, 2])) for n in range(300)] + [(300, None, 1.0, None)], "point_idx long, x double, y double, road_uid long")
    adjacent = spark.createDataFrame([(1, 2), (2, 1)], "uid_a long, uid_b long")
    got = sorted(tuple(r) for r in dbscan.unassociated_pairs(points, 6.0).collect())
    assert got == sorted(tuple(r) for r in dbscan.constrained_pairs(points, adjacent, 6.0).where("uid_i = -999").collect()) and len(got) > 100
