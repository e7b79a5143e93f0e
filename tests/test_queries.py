"""Each query against its SQL, at the smallest size."""

import os

import duckdb
import pytest

from roadloom import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    held = duckdb.connect()
    for name in os.listdir(SF):
        held.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return held


@pytest.mark.parametrize("name", queries.QUERIES)
def test_equals_sql(spark, engine, name):
    rows = queries.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted((tuple(r) for r in rows.select(*columns).collect()), key=repr)
    held = engine.execute(queries.SQL[name])
    names = [d[0] for d in held.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in held.fetchall()), key=repr)


def test_the_heat_layer_holds_the_points_of_the_labelled_table(spark):
    """Nothing is clustered for it: no job runs before its rows are asked for, and these are those of all labelled points."""
    folder = SF
    spark.sparkContext.setJobGroup("heat", "")
    heat = queries.heat_points(spark, folder)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("heat"))
    spark.sparkContext.setJobGroup("other", "")
    want = queries.labelled(spark, folder).groupBy("y", "x").count().collect()
    assert {tuple(r) for r in heat.collect()} == {(round(r["y"] / 100, 6), round(r["x"] / 100, 6), r["count"]) for r in want}
    assert jobs <= 2  # reading the schema


def test_pairs_without_a_road_are_made_of_these_points_only(spark, monkeypatch):
    far = {r["point_idx"] for r in queries.nearest_road(spark, SF).where("dist_to_road > 100").collect()}
    seen, real = [], queries.dbscan.eps_pairs
    monkeypatch.setattr(queries.dbscan, "eps_pairs", lambda points, eps: (seen.append({r["point_idx"] for r in points.collect()}), real(points, eps))[1])
    pairs = queries.unassociated_pairs(spark, SF).collect()
    assert seen == [far] and 0 < len(far) < 150 and {k for r in pairs for k in r} <= far
