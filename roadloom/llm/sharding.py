"""Resharding by minimum-cost flow.

Shards hold rows with a size in bytes. Given the sizes of the old shards and the capacities of the new ones, a
min-cost flow decides how many bytes each old shard keeps or sends to each new one, so that the fewest bytes
move (keeping costs 0, moving costs 1 a byte, or what a cost matrix says). The flow has one node per shard, so
it is solved on the driver; without a cost matrix it has an arc that keeps and one to a hub for each shard, and is
solved in one pass (10^5 shards in under a second). All that depends on rows is done by Spark:

* an old shard's rows stand on a line of bytes, ordered by block (size class from large to small, then a hash),
  and in a block by size, id and checksum;
* each flow arc owns an interval of that line, and a row goes where its middle lies. Large rows stand first, so
  the cuts fall among small rows and a shard misses its capacity by about one small row per arc;
* blocks hold about ``ROWS_PER_BLOCK`` rows, so no task gets a whole shard, whatever its size.

Defined cases: null text has size 16 (no bytes) and a null checksum becomes that of the empty text; a null id is
an id like any other; repeated rows are separate rows, and which of several equal rows stands first is open; texts of any length are
rows like others (only their size and checksum are shuffled); an empty table gives an empty result; other columns are
ignored unless they are named in ``carry``.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from roadloom.session import cut

ROW_OVERHEAD = 16
ROWS_PER_BLOCK = 200_000


def equal_capacities(total: int, shards: int) -> list[int]:
    """``total`` bytes dealt as evenly as whole bytes allow."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]] | None = None) -> dict[tuple[int, int], int]:
    """Bytes that go from each old to each new shard, at the least total cost.

    Without ``cost`` an old shard keeps bytes in the new shard of the same number for nothing, and a moved byte costs
    1: source -> old -> new of the same number (cost 0) or hub (cost 1) -> new -> sink. All shortest paths of cost 0 are the keeping ones,
    and every other path costs 1, so filling the keeping arcs and then the hub's is optimal; surpluses and needs that
    meet in the hub are paired in order. With ``cost``: successive shortest paths on source -> old -> new -> sink.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the new capacities can't hold all bytes")
    return _through_hub(supply, capacity) if cost is None else _shortest_paths(supply, capacity, cost)


def _through_hub(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    kept = [min(s, c) for s, c in zip(supply, capacity)]
    flow = {(k, k): amount for k, amount in enumerate(kept) if amount}
    rest = lambda of: [[k, amount - (kept[k] if k < len(kept) else 0)] for k, amount in enumerate(of)]
    needs = (x for x in rest(capacity) if x[1])
    need = next(needs, None)
    for i, surplus in rest(supply):
        while surplus:
            amount = min(surplus, need[1])
            flow[i, need[0]] = amount
            surplus -= amount
            need[1] -= amount
            if not need[1]:
                need = next(needs, None)
    return flow


def _shortest_paths(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, cap: int, c: int) -> None:
        for x, y, r, p in ((a, b, cap, c), (b, a, 0, -c)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(p)

    where = {}
    for i in range(n):
        for j in range(m):
            where[i, j] = len(to)
            add(i, n + j, sum(supply), cost[i][j])
        add(source, i, supply[i], 0)
    for j in range(m):
        add(n + j, sink, capacity[j], 0)
    while True:
        far = {source: 0}
        via: dict[int, int] = {}
        queue, queued = deque([source]), {source}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in arcs[u]:
                if room[e] and far[u] + price[e] < far.get(to[e], 1 << 62):
                    far[to[e]], via[to[e]] = far[u] + price[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if sink not in via:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return {ij: room[e ^ 1] for ij, e in where.items() if room[e ^ 1]}


def intervals(flow: dict[tuple[int, int], int], n: int) -> list[tuple[int, int, int, int]]:
    """(old, from, to, new): an old shard's line of bytes, what it keeps first."""
    out, ends = [], [0] * n
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        out.append((i, ends[i], ends[i] + amount, j))
        ends[i] += amount
    return out


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


def plan_transfers(rows: DataFrame, shards_old: int, shards_new: int, capacities: list[int] | None = None, cost=None) -> dict[tuple[int, int], int]:
    """The flow for ``rows`` with columns ``old`` and ``size``."""
    sizes = {r["old"]: r["s"] for r in rows.groupBy("old").agg(F.sum("size").alias("s")).collect()}  # one row per shard
    supply = [sizes.get(i, 0) for i in range(shards_old)]
    return min_cost_flow(supply, capacities or equal_capacities(sum(supply), shards_new), cost)


def assign(rows: DataFrame, flow: dict[tuple[int, int], int], shards_old: int, order: list[str]) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows`` (``old``, ``size`` and the columns in ``order``), as ``flow`` says."""
    spark = rows.sparkSession
    total = rows.count()
    parts = max(1, -(-total // (shards_old * ROWS_PER_BLOCK)))
    keys = ["old", "size_class", "part"]
    rows = rows.withColumns({"size_class": -F.floor(F.log2("size")).cast("int"), "part": F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")})
    line = Window.partitionBy("old").orderBy("size_class", "part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys).agg(F.sum("size").alias("bytes")).withColumn("offset", F.coalesce(F.sum("bytes").over(line), F.lit(0))).drop("bytes")
    by_size = [F.desc("size"), *order]
    within = Window.partitionBy(*keys).orderBy(*by_size).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(blocks, keys).withColumn("middle", F.col("offset") + F.sum("size").over(within) - F.col("size") / 2)
    arcs = spark.createDataFrame(intervals(flow, shards_old), "old int, lo long, hi long, shard int")
    hit = [placed["old"] == arcs["old"], placed["middle"] >= arcs["lo"], placed["middle"] < arcs["hi"]]
    moved = placed.join(F.broadcast(arcs), hit).drop(arcs["old"], "lo", "hi", "middle", "offset")  # at most one arc per pair of shards
    runs = [*keys, "shard"]
    moved = cut(moved.withColumn("nth", F.row_number().over(Window.partitionBy(*runs).orderBy(*by_size))))
    before = Window.partitionBy("shard").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = moved.groupBy(*runs).agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return moved.join(starts, runs).withColumn("slot", F.col("first") + F.col("nth") - 1).drop("first", "nth", "size_class", "part")


def reshard(docs: DataFrame, shards_old: int = 32, shards_new: int = 40, old: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """Put all ``docs`` into ``shards_new`` shards of near equal bytes, moving the fewest.

    ``old`` gives each row's present shard; without it the present layout is a hash of ``doc_id`` over
    ``shards_old``. Returns ``doc_id, size, text_crc32, old, shard, slot`` and the columns named in ``carry``.
    """
    held = F.pmod(F.xxhash64("doc_id"), F.lit(shards_old)) if old is None else old
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = cut(docs.select("doc_id", row_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), held.cast("int").alias("old"), F.struct(*carry).alias("carried") if carry else F.lit(None).alias("carried"), F.monotonically_increasing_id().alias("place")))
    flow = plan_transfers(rows, shards_old, shards_new)
    placed = assign(rows, flow, shards_old, ["doc_id", "text_crc32", "place"]).drop("place")  # equal rows differ in their place
    return placed.select("*", "carried.*").drop("carried") if carry else placed.drop("carried")


def rewrite(spark: SparkSession, old_path: str, new_path: str, shards_new: int) -> DataFrame:
    """Reshard a table in folders ``shard=<n>`` and rewrite the affected shards only.

    A shard is affected if it sends or gets bytes. The affected ones are written below ``new_path``, their rows in
    the order of their slots. The returned manifest (``shard, path``) names for each shard the folder that now
    holds its rows, which for an unaffected one is the old folder.
    """
    docs = spark.read.parquet(old_path)
    shards_old = int(docs.agg(F.max("shard")).first()[0] or 0) + 1
    payload = [c for c in docs.columns if c not in ("doc_id", "shard")]
    rows = docs.select("doc_id", F.struct(*payload).alias("payload"), row_size(F.col("text")).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.col("shard").cast("int").alias("old"))
    flow = plan_transfers(rows, shards_old, shards_new)
    touched = sorted({k for (i, j) in flow if i != j for k in (i, j)})
    if touched:
        part = {ij: a for ij, a in flow.items() if ij[0] in touched}
        assign(rows.where(F.col("old").isin(touched)), part, shards_old, ["doc_id", "text_crc32"]).repartition("shard").sortWithinPartitions("shard", "slot").select("doc_id", "payload.*", "shard").write.partitionBy("shard").parquet(new_path)
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType())])
    return spark.createDataFrame([(k, f"{new_path if k in touched else old_path}/shard={k}") for k in range(max(shards_new, shards_old)) if k in touched or any(k in ij for ij in flow)], schema)
