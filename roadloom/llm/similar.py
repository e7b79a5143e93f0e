"""SimHash near-duplicates by similarity: texts whose sets of five-word shingles have a Jaccard similarity of
``SIMILAR`` or more are linked, after an exact test.

1. Each text becomes the set of its shingles' hashes; equal sets are one node, with a 64-bit SimHash.
2. Buckets: ``BANDS`` keys of ``ROWS`` minima of the set under different hashes. A pair of similarity 0.8 shares no
   bucket with a probability under one in a million, one of 0.5 shares some nine times in ten, one of 0.2 one time in seven.
3. Fingerprints: of a pair of similarity 0.8 ten bits differ on average, with a standard deviation of 3; ``RADIUS`` is five
   of them above.
4. Stars: for ``STARS`` rounds each bucket has one pivot (another in each round), and each node that isn't in its component goes on with
   the nearest of its buckets' pivots to an exact test. So groups of copies, however large, are connected by about as many pairs as they
   have nodes. Their sketches have to allow the similarity (each member of a set flips one of ``SKETCH`` bits, so differing bits
   never exceed differing members).
5. Rest: in buckets that still hold several components, all fingerprints of different ones are compared bit-sliced, in
   pairs of tiles of at most ``TILE`` members, and those within the radius by their sketches; a pair is told in the
   first bucket that it shares only. Of these pairs one for each node is tested exactly first, then those that still lie between components.

Exact tests send a set once for each pair, and the set of the pair's hub once for up to ``TILE`` pairs; sets in no pair aren't sent.
Buckets are joined with their pivots and dealt into tiles by Spark, so no bucket stands in one task.

Defined cases: words stand between white space, lower-cased; a text with fewer words than a shingle is one shingle; null
and blank texts are the empty set and one node; of a group the smallest id stays, of its rows the one with the least hash of the text;
a text of any length is read whole, in a block of its own; an empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm import simhash
from roadloom.llm.columnar import Words, blocks, mix
from roadloom.operators.components import connected_components
from roadloom.session import cut

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS, RADIUS, STARS, SKETCH = 20, 3, 24, 2, 512
TILE, SMALL = 2048, 64
#: Up to this many texts that are compared are found by a table sent to all tasks.
BROADCAST_ROWS = 100_000
#: Bytes of text that are hashed at a time.
BLOCK = 1_000_000
_SKETCH = [f"s{k}" for k in range(SKETCH // 64)]
_KEYS = [f"k{k}" for k in range(BANDS // 2)]
_ODD = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The row and hash of each text's distinct shingles, in order."""
    hashes = words.hashes()
    rows, values = [], []
    for k in range(1, SHINGLE + 1):
        value, at = words.runs(hashes, k)
        row = words.doc[at]
        own = words.counts[row] == k if k < SHINGLE else slice(None)  # short texts: the whole sequence
        rows.append(row[own])
        values.append(value[own])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def _names(row: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    out = np.zeros(len(n), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(out, row, mix(value))
        return mix(out + n.astype(np.uint64))


def _bands(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bucket keys of each set that isn't empty; ``value`` has the sets of sizes ``n`` in turn."""
    size = n[n > 0]
    begin = np.cumsum(size) - size
    keys = np.zeros((len(size), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            for k in range(ROWS):
                least = np.minimum.reduceat(value * _ODD[band * ROWS + k], begin) if len(size) else keys[:, band]
                keys[:, band] = mix(keys[:, band] + least + np.uint64(band))
    return keys


def _sketches(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """For each set whether each of ``SKETCH`` bits is hit an odd number of times, as words, one row for each word."""
    out = np.zeros((SKETCH // 64, rows), np.uint64)
    for a in range(0, rows, 1000):
        own = slice(*np.searchsorted(row, [a, a + 1000]).tolist())
        some = min(1000, rows - a)
        hits = np.bincount((row[own] - a) * SKETCH + (value[own] % np.uint64(SKETCH)).astype(np.int64), minlength=some * SKETCH)
        odd = (hits & 1).astype(np.uint8).reshape(some, SKETCH)
        out[:, a : a + some] = np.packbits(odd, axis=1, bitorder="little").view("<u8").T
    return out


def prints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, the ``node`` of the text's set, its size ``n``, fingerprint ``fp``, sketch and bucket ``keys``."""

    def of_block(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        words = Words(data, offsets)
        row, value = shingle_sets(words)
        n = np.bincount(row, minlength=words.n)
        splits = np.r_[0, np.cumsum(BANDS * (n > 0))].astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(splits), pa.array(_bands(value, n).ravel().view(np.int64)))
        sketches = [pa.array(x.view(np.int64)) for x in _sketches(row, value, words.n)]
        return [pa.array(_names(row, value, n).view(np.int64)), pa.array(n), pa.array(simhash.bit_majority(value, n).view(np.int64)), *sketches, keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(2), BLOCK):
                rest = [batch.column(k).slice(first, len(offsets) - 1) for k in range(2)]
                yield pa.record_batch([*rest, *of_block(data, offsets)], ["doc_id", "text_hash", "node", "n", "fp", *_SKETCH, "keys"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(docs).alias("text_hash"), F.col("text").alias("text"))
    return cut(held.mapInArrow(run, f"doc_id long, text_hash long, node long, n long, fp long, {', '.join(f'{c} long' for c in _SKETCH)}, keys array<long>"))


def text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _by_run(use):
    """``use`` on whole runs of equal first columns, of which a batch may hold many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            fresh = np.stack([batch.column(k).to_numpy() for k in range(batch.num_columns)])
            held = fresh if held is None else np.concatenate([held, fresh], axis=1)
            if held.shape[1]:
                done = int(np.searchsorted(held[0] == held[0, -1], True))  # all but the last run, which may go on
                if done:
                    yield from use(held[:, :done])
                    held = held[:, done:]
        if held is not None and held.shape[1]:
            yield from use(held)

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, node, set), a hub's own row before those that are held against it: the pairs whose similarity reaches ``SIMILAR``."""
    held = np.zeros(0, np.uint64)
    for batch in batches:
        hub, node, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        near = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            members = np.frombuffer(sets[k].as_buffer(), np.uint64)
            if hub[k] == node[k]:
                held = members.copy()
            else:
                both = len(np.intersect1d(held, members, assume_unique=True))
                near[k] = 5 * both >= 4 * (len(held) + len(members) - both)
        yield pa.record_batch([pa.array(np.minimum(hub, node)), pa.array(np.maximum(hub, node))], ["a", "b"]).filter(pa.array(near))


def _sent(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``rows``, sent to all tasks in a join if there are at most ``most`` (``BROADCAST_ROWS``)."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _sizes_allow(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_component(entries: DataFrame, reached: DataFrame | None) -> DataFrame:
    if reached is None:
        return entries.withColumn("component", F.col("node"))
    return entries.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _star(entries: DataFrame, turn: int) -> DataFrame:
    """For each node the nearest pivot of another component within the radius, as a pair."""
    pivot = F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "n", "fp", "component")
    pivots = entries.groupBy("key").agg(F.min(pivot).alias("p"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "p")
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp")))
    near = entries.join(pivots, "key").where(F.col("component") != F.col("p.component")).where(_sizes_allow(F.col("n"), F.col("p.n")) & (differ <= RADIUS))
    best = near.groupBy("node").agg(F.min(F.struct(differ.alias("differ"), F.col("p.node").alias("other"))).alias("best"))
    return best.select(*_ordered(F.col("node"), F.col("best.other"))).distinct()


def _within_runs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (group, tile, fp, node, n, component, band, sketch, keys), sorted by group: pairs of different components that may be similar.

    They are within the radius, their sketches allow the similarity, and no earlier band has them in one bucket.
    """
    group, tile, fp = rows[0], rows[1], rows[2].view(np.uint64)
    node, n, component, band = rows[3:7]
    sketch = rows[7 : 7 + len(_SKETCH)].view(np.uint64)
    keys = np.ascontiguousarray(rows[7 + len(_SKETCH) :].T).view("<u4")

    def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        may = (component[a] != component[b]) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
        a, b = a[may], b[may]
        may = 9 * sum(np.bitwise_count(s[a] ^ s[b]).astype(np.int64) for s in sketch) <= n[a] + n[b]
        a, b = a[may], b[may]
        may = (keys[a] == keys[b]).argmax(axis=1) == band[a]
        a, b = node[a[may]], node[b[may]]
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[begin, len(group)])
    small = np.flatnonzero(np.repeat(size <= SMALL, size))
    for d in range(1, SMALL):
        a = np.flatnonzero(group[small[:-d]] == group[small[d:]])
        if not len(a):
            break
        differ = simhash.planes(fp[small[a]] ^ fp[small[a + d]])  # distance of a pair: the weight of its difference
        near = np.unpackbits(simhash.within(np.zeros(1, np.uint64), differ, RADIUS)[0].view(np.uint8), bitorder="little")[: len(a)].astype(bool)
        yield told(small[a[near]], small[a[near] + d])
    for b, e in zip(begin[size > SMALL].tolist(), (begin + size)[size > SMALL].tolist()):
        tiles = [b + np.flatnonzero(tile[b:e] == t) for t in np.unique(tile[b:e])]
        one, other = tiles[0], tiles[-1]
        sliced = simhash.planes(fp[other])
        for k in range(0, len(one), 128):
            some = one[k : k + 128]
            mask = np.unpackbits(simhash.within(fp[some], sliced, RADIUS).view(np.uint8), axis=1, bitorder="little")[:, : len(other)]
            x, y = np.nonzero(mask)
            x, y = some[x], other[y]
            yield told(x[x < y], y[x < y]) if len(tiles) == 1 else told(x, y)


def _rest(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs that may be similar in buckets that hold several components, of different ones; ``nodes`` have the sketches and keys."""
    about = entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high")
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    rows = entries.join(about.select("key", tiles.alias("tiles")), "key").join(nodes, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    pairs = F.expr("transform(sequence(0, tiles - 1), t -> cast(least(tile, t) as bigint) * tiles + greatest(tile, t))")
    rows = rows.select("key", F.explode(pairs).alias("pair"), F.col("tile").cast("long"), "fp", "node", "n", "component", F.col("band").cast("long"), *_SKETCH, *_KEYS)
    rows = rows.select(F.xxhash64("key", "pair").alias("group"), "tile", "fp", "node", "n", "component", "band", *_SKETCH, *_KEYS)
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(_by_run(_within_runs), "a long, b long")


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and ``members`` (hashes, as bytes) of the ``wanted`` nodes, from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1), BLOCK):
                row, value = shingle_sets(Words(data, offsets))
                ends = np.searchsorted(row, np.arange(len(offsets)))
                held = [value[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.record_batch([batch.column(0).slice(first, len(held)), pa.array(held, pa.binary()), batch.column(2).slice(first, len(held))], ["node", "members", "many"])

    chosen = rows.select("node", F.struct("doc_id", "text_hash").alias("of")).join(wanted, "node", "left_semi").groupBy("node").agg(F.min("of").alias("of"), (F.count(F.lit(1)) > 1).alias("many"))
    chosen = cut(chosen.select("node", "many", F.col("of.doc_id").alias("key_id"), F.col("of.text_hash").alias("key_hash")))
    same = docs["doc_id"].cast("long").eqNullSafe(chosen["key_id"]) & (text_hash(docs) == chosen["key_hash"])
    texts = docs.join(_sent(chosen), same).select(chosen["node"], docs["text"], chosen["many"])
    sets = cut(texts.mapInArrow(run, "node long, members binary, many boolean"))
    repeated = cut(sets.where("many").dropDuplicates(["node"]))  # rows of one id and text may be repeated
    return sets.where("not many").union(repeated).select("node", "members")


def _allowed(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """The pairs whose sketches allow the similarity."""
    for end in ("a", "b"):
        pairs = pairs.join(about.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in _SKETCH]), end)
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _SKETCH), F.lit(0))
    return cut(pairs.where(9 * differ <= F.col("n_a") + F.col("n_b")).select("a", "b"))


def _verified(sets: DataFrame, pairs: DataFrame, turn: int) -> DataFrame:
    """The pairs whose similarity reaches ``SIMILAR``. A pair's hub is the end that is a pivot in this turn rather than the other."""
    first = F.xxhash64("a", F.lit(turn)) < F.xxhash64("b", F.lit(turn))
    pairs = pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"))
    tiles = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    spokes = cut(pairs.join(tiles, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"), "node"))
    ends = cut(spokes.union(spokes.select("hub", "tile", F.col("hub").alias("node")).distinct()))
    rows = sets.join(_sent(ends), "node").repartition("hub", "tile").sortWithinPartitions("hub", "tile", F.col("hub") != F.col("node"))
    return cut(rows.select("hub", "node", "members").mapInArrow(_similar, "a long, b long"))


def _untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def _between(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(reached.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")), end, "left")
    return pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def components(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``node`` and ``component`` of every node that is linked to another; ``rows`` are the ``prints`` of ``docs``."""
    nodes = cut(rows.drop("doc_id", "text_hash").dropDuplicates(["node"]))
    entries = nodes.select(F.posexplode("keys").alias("band", "key"), "node")
    shared = cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key"))
    entries = cut(entries.join(_sent(shared, 10 * BROADCAST_ROWS), "key").join(nodes.select("node", "n", "fp"), "node"))
    wanted = cut(entries.select("node").distinct())
    sets = _sets(docs, rows, wanted)
    half = lambda k: F.get("keys", F.lit(k)).bitwiseAND(0xFFFFFFFF)
    keys = [F.shiftleft(half(2 * k + 1), 32).bitwiseOR(half(2 * k)).alias(c) for k, c in enumerate(_KEYS)]
    about = cut(nodes.join(_sent(wanted), "node", "left_semi").select("node", "n", *_SKETCH, *keys))
    sketches = _sent(about.select("node", "n", *_SKETCH))
    edges, tested, reached = None, None, None
    for turn in range(STARS + 2):
        if turn < STARS:
            pairs = cut(_untested(_star(_with_component(entries, reached), turn), tested))
            tested = pairs if tested is None else tested.union(pairs)
            pairs = _allowed(pairs, sketches)
        elif turn == STARS:
            rest = cut(_untested(_rest(_with_component(entries, reached), about.drop("n")), tested))
            least = F.min_by("b", F.xxhash64("b", F.lit(turn)))
            pairs = cut(rest.groupBy("a").agg(least.alias("b")))
        else:
            pairs = cut(_between(_untested(rest, pairs), reached))
        fresh = _verified(sets, pairs, turn)
        edges = fresh if edges is None else edges.union(fresh)
        reached = cut(connected_components(edges)) if reached is None or not fresh.isEmpty() else reached
    return reached


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. All columns of ``docs`` are kept."""
    rows = prints(docs)
    named = rows.select("doc_id", "text_hash", "node").join(components(docs, rows), "node", "left")
    return simhash.one_of_each(docs, rows, named.withColumn("component", F.coalesce("component", "node")))
