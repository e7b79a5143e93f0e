"""SimHash near-duplicates, compared bit-sliced.

Fingerprints: bit b of a text is set if over half of its shingle hashes have it. Fingerprints link at
``RADIUS`` or fewer differing bits. Equal fingerprints are one node. The 64 bits are cut into five blocks; two
nodes that differ in three bits agree on two blocks at least, so every link is found in one of ten tables keyed
by a pair of blocks (about 26 bits, so buckets stay small when the corpus grows). A bucket's fingerprints stand
as 64 bit planes; carry-save counters add up the differing bits of all its members at once and give up once all
members exceed the radius. Buckets of more than ``TILE`` members are compared as pairs of tiles in separate
groups, and a group returns links to the representative of what it connects, never all pairs.

Defined cases: null and blank texts have no shingles and the fingerprint zero, linked like any other; texts with
fewer words than a shingle have one shingle; repeated rows are copies; a null id never names a component unless
the whole component has none; an empty table gives an empty result; other columns are ignored. A text of any length is
hashed whole, in a block of its own (some forty bytes a byte of its words while its shingles are hashed).
For ``deduplicate`` a null text is a copy of the empty one: of such rows of one id one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.columnar import Words, blocks
from roadloom.operators.components import connected_components
from roadloom.session import cut

RADIUS, SHINGLE = 3, 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit, width
TILE = 4096
#: Bytes of text that are hashed at a time.
BLOCK = 1_000_000
#: Up to this many keys of documents that go are sent to all tasks; beyond that, keys of those that stay are joined.
BROADCAST_ROWS = 100_000
SMALL = 64


def bit_majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint per text from the hashes of its shingles (``counts`` of them each, in turn)."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.cumsum(counts[some]) - counts[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * sums > counts[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of some byte ranges. Ranges of one length are hashed together; rare lengths go to the library one by one."""
    from xxhash import xxh64_intdigest

    out, length = np.zeros(len(starts), np.uint64), ends - starts
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))  # the eight bytes from every place
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        rows, n = order[a:b], int(length[order[a]])
        if b - a < 4 or n > 512:
            out[rows] = [xxh64_intdigest(held[x : x + n].tobytes(), seed) for x in starts[rows].tolist()]
            continue
        at, done = starts[rows], 0
        with np.errstate(over="ignore"):
            step = lambda acc, x: _turned(acc + x * _P2, 31) * _P1
            zero, s = np.zeros(len(rows), np.uint64), np.uint64(seed)
            if n >= 32:
                four = [zero + s + _P1 + _P2, zero + s + _P2, zero + s, zero + s - _P1]
                for done in range(0, n - 31, 32):
                    four = [step(v, eights[at + done + 8 * k]) for k, v in enumerate(four)]
                done += 32
                h = _turned(four[0], 1) + _turned(four[1], 7) + _turned(four[2], 12) + _turned(four[3], 18)
                for v in four:
                    h = (h ^ step(zero, v)) * _P1 + _P4
            else:
                h = zero + s + _P5
            h = h + np.uint64(n)
            while n - done >= 8:
                h = _turned(h ^ step(zero, eights[at + done]), 27) * _P1 + _P4
                done += 8
            if n - done >= 4:
                h = _turned(h ^ (eights[at + done] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
                done += 4
            for k in range(done, n):
                h = _turned(h ^ held[at + k].astype(np.uint64) * _P5, 11) * _P1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def shingle_hashes(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each text's ``k``-word shingles, space-joined, repeats included, and their counts."""
    size = words.ends - words.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    joined = np.full(int(size.sum()) + len(size), ord(" "), np.uint8)
    inside = np.ones(len(joined), bool)
    inside[ends] = False
    joined[inside] = words.data[words.flag]
    width = np.minimum(words.counts, k)  # short texts: the whole sequence
    counts = np.where(words.counts > 0, words.counts - width + 1, 0)
    doc = np.repeat(np.arange(words.n), counts)
    first = words.bounds[doc] + np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
    begin, end = starts[first], ends[first + width[doc] - 1] if len(size) else first
    return xxh64(joined, begin, end), counts


def fingerprints(docs: DataFrame, keep: dict | None = None) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a long) of each row, and the columns in ``keep``."""
    keep = keep or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.uint64)]
            for _, data, offsets in blocks(batch.column(batch.num_columns - 1), BLOCK):
                out.append(bit_majority(*shingle_hashes(Words(data, offsets))))
            rest = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.record_batch([*rest, pa.array(np.concatenate(out).view(np.int64))], [*batch.schema.names[:-1], "fp"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in keep.items()], F.col("text").alias("text"))
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "fp long"]))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 values a word."""
    n = len(values)
    bits = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, sliced: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Packed masks (query by word of 64 members): who differs from each query in ``radius`` or fewer bits.

    Three planes at a time go through a full adder; its sum and carry enter counters of a few bits, which start so
    high that they overflow at ``radius + 1``. What overflows is over the radius for good. Once all members are, the
    rest of the planes is left out.
    """
    full = ~np.uint64(0)
    shape, width = (len(queries), sliced.shape[1]), max(radius.bit_length(), 2)
    over = np.zeros(shape, np.uint64)
    counters = [np.full(shape, full if ((1 << width) - 1 - radius) >> k & 1 else 0, np.uint64) for k in range(width)]

    def differing(b: int) -> np.ndarray:
        flip = np.where((queries >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
        return sliced[b][None, :] ^ flip[:, None]

    def add(x: np.ndarray, level: int) -> None:
        for k in range(level, width):
            up = counters[k] & x
            counters[k] ^= x
            x = up
        np.bitwise_or(over, x, out=over)

    for b in range(0, 63, 3):
        x, y, z = differing(b), differing(b + 1), differing(b + 2)
        half = x ^ y
        add(half ^ z, 0)
        add((x & y) | (half & z), 1)
        if b % 12 == 9 and (over == full).all():
            break
    else:
        add(differing(63), 0)
    return ~over


def connect(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of a bucket's fingerprints the first one that links reach from it."""
    n = len(values)
    sliced = planes(values)
    root = np.full(n, -1)
    left = np.zeros(sliced.shape[1] * 64, bool)
    left[:n] = True
    for k in range(n):
        if not left[k]:
            continue
        root[k], left[k] = k, False
        wave = np.array([k])
        while len(wave):
            found = np.zeros(len(left), bool)
            for at in range(0, len(wave), 128):
                mask = np.bitwise_or.reduce(within(values[wave[at : at + 128]], sliced, radius), axis=0)
                found |= np.unpackbits(mask.view(np.uint8), bitorder="little").astype(bool)
            wave = np.flatnonzero(found & left)
            root[wave], left[wave] = k, False
    return root


def connect_small(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """``connect`` for many small buckets at once: equal ``keys`` stand together."""
    n = len(values)
    label = np.arange(n)
    pairs_a, pairs_b = [], []
    for d in range(1, SMALL):
        a = np.flatnonzero(keys[: n - d] == keys[d:]) if n > d else np.zeros(0, int)
        if not len(a):
            break
        differ = planes(values[a] ^ values[a + d])  # distance of a pair: the weight of its difference
        near = np.unpackbits(within(np.zeros(1, np.uint64), differ, radius)[0].view(np.uint8), bitorder="little")[: len(a)].astype(bool)
        pairs_a.append(a[near])
        pairs_b.append(a[near] + d)
    if pairs_a:
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
    return label


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp), sorted by key: edges (fp, representative)."""

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[begin, len(keys)])
        root = np.arange(len(keys))
        small = np.repeat(size <= SMALL, size)
        at = np.flatnonzero(small)
        if len(at):
            root[at] = at[connect_small(keys[at], fps[at])]
        for b, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist()):
            root[b : b + n] = b + connect(fps[b : b + n])
        at = np.flatnonzero(root != np.arange(len(keys)))
        return pa.record_batch([pa.array(fps[at].view(np.int64)), pa.array(fps[root[at]].view(np.int64))], ["a", "b"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.r_[keys, batch.column(0).to_numpy()]
        fps = np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
        if not len(keys):
            continue
        done = int(np.searchsorted(keys == keys[-1], True))  # all but the last run, which may go on
        if done:
            yield edges(keys[:done], fps[:done])
            keys, fps = keys[done:], fps[done:]
    if len(keys):
        yield edges(keys, fps)


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fp`` as links within the radius do."""
    part = lambda b: F.shiftright(F.col("fp"), b[0]).bitwiseAND((1 << b[1]) - 1)
    tables = [(F.shiftleft(F.lit(t).cast("long"), 32) + F.shiftleft(part(x), 13) + part(y)).alias("key") for t, (x, y) in enumerate(combinations(BLOCKS, 2))]
    rows = nodes.select("fp", F.explode(F.array(*tables)).alias("key"))
    # counted with map-side combine and joined back, so that one large bucket may be read by many tasks
    rows = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = rows.withColumns({"tiles": tiles, "own": F.pmod(F.xxhash64("fp"), tiles).cast("int")})
    # a bucket of one tile stays whole; of a larger one, each row goes to every pair of tiles that has its own
    pairs = F.expr("transform(filter(sequence(0, tiles - 1), t -> t <> own), t -> cast(least(own, t) as bigint) * tiles + greatest(own, t))")
    rows = rows.select("key", "fp", F.explode(F.when(F.col("tiles") > 1, pairs).otherwise(F.array(F.lit(0).cast("long")))).alias("pair"))
    rows = rows.select(F.xxhash64("key", "pair").alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_link_runs, "a long, b long")


def components(prints: DataFrame) -> DataFrame:
    """Add ``component_id``, the smallest ``doc_id`` that links reach, to rows with ``doc_id`` and ``fp``."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reached = connected_components(links(nodes)).withColumnRenamed("node", "fp")
    named = nodes.join(reached, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "component").select("fp", "component_id", "component"), "fp")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the smallest id. All columns of ``docs`` are kept."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    prints = cut(fingerprints(docs, {"text_hash": text_hash}))
    return one_of_each(docs, prints, components(prints))


def one_of_each(docs: DataFrame, prints: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without those that aren't the first of their ``component``; ``prints`` and ``rows`` have ``doc_id`` and ``text_hash``."""
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_hash"))
    best = rows.groupBy("component").agg(F.min(rank).alias("best")).select("best.doc_id", "best.text_hash")
    key = {"key_id": F.col("doc_id"), "key_hash": F.col("text_hash")}
    same = lambda of: docs["doc_id"].cast("long").eqNullSafe(of["key_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == of["key_hash"])
    stays = cut(best.select(*(c.alias(k) for k, c in key.items())))
    keys = prints.select(*(c.alias(k) for k, c in key.items())).distinct()
    goes = cut(keys.join(stays, keys["key_id"].eqNullSafe(stays["key_id"]) & (keys["key_hash"] == stays["key_hash"]), "left_anti"))
    if goes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = docs.join(F.broadcast(goes), same(goes), "left_anti")
    else:
        kept = docs.join(stays, same(stays), "left_semi")
    if prints.count() > keys.count():  # repeated rows of one id and text: one of them stays
        whole = "_text"
        while whole in kept.columns:
            whole += "_"
        kept = kept.withColumn(whole, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", whole]).drop(whole)
    return kept
