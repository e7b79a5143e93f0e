import random
import zlib
from collections import Counter, defaultdict

import pytest

from roadloom.llm import sharding


def check(rows, docs):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, held = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return held


def test_all_rows_once_and_near_equal(docs):
    held = check(sharding.reshard(docs, 4, 5).collect(), docs)
    mean = sum(held.values()) / 5
    assert len(held) == 5 and max(abs(v - mean) for v in held.values()) < 0.02 * mean


def test_edges(edge, nothing):
    check(sharding.reshard(edge, 3, 4).collect(), edge)
    assert sharding.reshard(nothing, 3, 4).collect() == []


@pytest.mark.parametrize("supply,capacity", [([7, 5, 3], [5, 5, 5]), ([10, 0], [2, 4, 4]), ([4, 4, 4, 4], [8, 8]), ([0, 0], [1, 1])])
def test_flow_moves_the_fewest(supply, capacity):
    flow = sharding.min_cost_flow(supply, capacity)
    for i, s in enumerate(supply):
        assert sum(a for (k, _), a in flow.items() if k == i) == s
    for j, c in enumerate(capacity):
        assert sum(a for (_, k), a in flow.items() if k == j) <= c
    moved = sum(a for (i, j), a in flow.items() if i != j)
    assert moved == sum(max(0, s - (capacity[i] if i < len(capacity) else 0)) for i, s in enumerate(supply))


def test_flow_needs_room():
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4])


def test_rewrite_touches_affected_shards_only(shipped, docs, tmp_path):
    from pyspark.sql import functions as F

    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(3))).write.partitionBy("shard").parquet(old)
    manifest = {r["shard"]: r["path"] for r in sharding.rewrite(shipped, old, new, 4).collect()}
    assert sorted(manifest) == [0, 1, 2, 3]
    rows = [r["doc_id"] for path in manifest.values() for r in shipped.read.parquet(path).select("doc_id").collect()]
    assert sorted(rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_hub_equals_shortest_paths_and_takes_many_shards():
    rng = random.Random(3)
    for _ in range(40):
        n, m = rng.randint(1, 6), rng.randint(1, 7)
        supply = [rng.randint(0, 20) for _ in range(n)]
        capacity = sharding.equal_capacities(sum(supply) + rng.randint(0, 5), m)
        moved = lambda flow: sum(a for (i, j), a in flow.items() if i != j)
        dense = sharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(m)] for i in range(n)])
        hub = sharding.min_cost_flow(supply, capacity)
        assert moved(hub) == moved(dense) and all(a > 0 for a in hub.values())
        assert [sum(a for (k, _), a in hub.items() if k == i) for i in range(n)] == supply
        assert all(sum(a for (_, k), a in hub.items() if k == j) <= c for j, c in enumerate(capacity))
    supply = [rng.randint(0, 10**9) for _ in range(20_000)]
    flow = sharding.min_cost_flow(supply, sharding.equal_capacities(sum(supply), 25_000))
    assert len(flow) <= 3 * 25_000 and sum(flow.values()) == sum(supply)
    assert len(sharding.intervals(flow, len(supply))) == len(flow)


def test_moved_rows_weigh_what_the_flow_says(docs):
    rows = sharding.reshard(docs, 4, 5).collect()
    size = [sum(r["size"] for r in rows if r["old"] == k) for k in range(4)]
    flow = sharding.min_cost_flow(size, sharding.equal_capacities(sum(size), 5))
    largest = max(r["size"] for r in rows)
    for i in range(4):
        for j in range(5):
            assert abs(sum(r["size"] for r in rows if (r["old"], r["shard"]) == (i, j)) - flow.get((i, j), 0)) <= largest


def test_rewrite_leaves_balanced_shards_alone(shipped, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    rows = [(k, "x" * 84, shard) for k, shard in enumerate([0, 0, 1, 1, 1, 2])]
    shipped.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(old)
    manifest = {r["shard"]: r["path"] for r in sharding.rewrite(shipped, old, new, 3).collect()}
    assert manifest == {0: f"{old}/shard=0", 1: f"{new}/shard=1", 2: f"{new}/shard=2"}
    held = {k: sorted(r["doc_id"] for r in shipped.read.parquet(path).collect()) for k, path in manifest.items()}
    assert held[0] == [0, 1] and len(held[1]) == len(held[2]) == 2 and 5 in held[2] and sorted(sum(held.values(), [])) == list(range(6))


def test_equal_rows_spread_over_the_blocks(shipped, monkeypatch):
    """Copies of one row are dealt over all blocks of their size, and no column is added."""
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 100)
    docs = shipped.createDataFrame([(7, "the same text")] * 3_000, "doc_id long, text string").repartition(4)
    blocks, hashed = [], sharding.F.xxhash64

    def watched(*columns):
        blocks.append(columns)
        return hashed(*columns)

    monkeypatch.setattr(sharding.F, "xxhash64", watched)
    out = sharding.reshard(docs, 3, 4)
    rows = out.collect()
    held = check(rows, docs)
    assert set(out.columns) == {"doc_id", "size", "text_crc32", "old", "shard", "slot"}
    assert ("doc_id", "text_crc32", "place") in blocks and max(held.values()) - min(held.values()) <= 2 * rows[0]["size"]
