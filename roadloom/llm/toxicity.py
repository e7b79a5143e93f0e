"""Toxicity: a bidirectional gated recurrent network with attention pooling, over all overlapping windows of a text.

A word's input is the embedding of the word and the pooled embeddings of all its character 4-grams, so a word that was
never seen still has its stem. Words of over ``LONGEST`` bytes (scripts without spaces) are cut into pieces that share
their last 4-gram's beginning, each a word of its own. A window of ``WINDOW`` words runs through a recurrent layer in
either direction; attention weighs the states, and a text's score is that of its highest window. Windows start every
``STRIDE`` words, and one ends with the text, so neighbours share all words but ``STRIDE`` and every run of up to
``WINDOW - STRIDE + 1`` words stands whole in a window, wherever it is in the text.

Training is plain numpy in one task, on a bounded sample of labelled rows: ``SAMPLE`` rows of each label, the
least by a hash of the id among texts of at most ``SAMPLE_BYTES``, ``SAMPLE_TOTAL`` bytes in all. Only the fit has these bounds; scoring covers all rows
and whole texts. As a label marks a text and not a window, each epoch trains on the window of each text that the
network scores highest (of those that start every ``FIT_STRIDE`` words). One dimension of either table starts as the smoothed log-odds of a word or 4-gram.

Defined cases: null and blank texts have no words and get the lowest score of the sample; repeated rows are scored each;
a null id is not held out and never learned from; labels that are null, or join no document, are left out; of equally
high windows any gives the score; a text of any length is scored whole, in a block of its own (some thirty bytes a byte
of text; states are held for ``CHUNK`` windows, gates for ``SLAB``); without rows of both labels every text gets the share of label 1 (0.0 without any labels); an empty table gives
an empty result; other columns are ignored by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadloom.llm.columnar import ALNUM, Words, blocks
from roadloom.session import cut, ship

WINDOW, STRIDE, FIT_STRIDE = 32, 8, 16
SAMPLE, SAMPLE_BYTES, SAMPLE_TOTAL = 2500, 60_000, 32_000_000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
HIDDEN, WORD_DIM, CHAR_DIM = 8, 4, 4
WORD_ROWS, CHAR_ROWS, GRAM, LONGEST = 1 << 15, 1 << 16, 4, 48
BLOCK, CHUNK, SLAB = 1_000_000, 512, 16_384
PRIOR = 20.0


def gram_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character 4-grams of each word in turn, the word's ends marked, and how many each word has."""
    length = ends - starts
    count = np.maximum(length + 3 - GRAM, 1)
    word = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    size, begin = length[word], starts[word] - 1
    key = np.zeros(len(word), np.uint64)
    for k in range(GRAM):
        place = nth + k  # 0 and size + 1 are the marks
        byte = data[np.clip(begin + place, 0, max(len(data) - 1, 0))].astype(np.uint64) + np.uint64(2) if len(data) else np.zeros(len(word), np.uint64)
        byte = np.where((place == 0) | (place == size + 1), np.uint64(1), np.where(place <= size, byte, np.uint64(0)))
        key = (key << np.uint64(9)) | byte
    with np.errstate(over="ignore"):
        hashed = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)
    return (hashed % np.uint64(CHAR_ROWS)).astype(np.int32), count


class Block:
    """A block of texts as distinct words, and windows of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, ALNUM)
        words.cut_long(LONGEST, GRAM - 1)
        self.hashes, first, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.counts, self.bounds, self.n = words.counts, words.bounds, words.n
        self.word_bucket = (self.hashes >> np.uint64(40)).astype(np.int64) % WORD_ROWS
        self.grams, self.gram_counts = gram_buckets(words.data, words.starts[first], words.ends[first])
        self.distinct = len(first)

    def part(self, some: np.ndarray) -> Block:
        """Some of the distinct words, without texts."""
        out = Block.__new__(Block)
        out.word_bucket, out.gram_counts, out.distinct = self.word_bucket[some], self.gram_counts[some], len(some)
        begin = (np.cumsum(self.gram_counts) - self.gram_counts)[some]
        out.grams = self.grams[np.repeat(begin, out.gram_counts) + np.arange(out.gram_counts.sum()) - np.repeat(np.cumsum(out.gram_counts) - out.gram_counts, out.gram_counts)]
        return out

    @classmethod
    def joined(cls, column: pa.Array) -> Block:
        """All texts of a column as one."""
        parts, out = [cls(data, offsets) for _, data, offsets in blocks(column, BLOCK)], cls.__new__(cls)
        out.hashes, first, place = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
        before = np.cumsum([0, *(p.distinct for p in parts)])
        out.word = np.concatenate([place[b + p.word] for p, b in zip(parts, before)])
        out.counts, out.n, out.distinct = np.concatenate([p.counts for p in parts]), len(column), len(first)
        out.bounds = np.concatenate([[0], np.cumsum(out.counts)])
        out.word_bucket, out.grams, out.gram_counts = (np.concatenate([getattr(p, name) for p in parts]) for name in ("word_bucket", "grams", "gram_counts"))
        some = out.part(first)
        out.word_bucket, out.grams, out.gram_counts = some.word_bucket, some.grams, some.gram_counts
        return out

    def windows(self, stride: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first word within its text of each window, and the row of each window."""
        stride = stride or STRIDE
        each = np.maximum(1, -(-np.maximum(self.counts - WINDOW, 0) // stride) + 1)
        row = np.repeat(np.arange(self.n), each)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        return np.minimum(nth * stride, np.maximum(self.counts - WINDOW, 0)[row]), row

    def words(self, start: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Word numbers of some windows, ``distinct`` where a short text ends."""
        at = start[:, None] + np.arange(WINDOW)
        inside = at < self.counts[row][:, None]
        held = np.append(self.word, self.distinct)
        return np.where(inside, held[np.minimum(self.bounds[:-1][row][:, None] + at, len(held) - 1)], self.distinct)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, forward and backward passes. Directions stand in the first axis: 0 forward, 1 backward."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.p = {
            "word": draw(WORD_ROWS, WORD_DIM, s=0.05),
            "char": draw(CHAR_ROWS, CHAR_DIM, s=0.05),
            "wx": draw(2, d, 3 * HIDDEN, s=d**-0.5),
            "wh": draw(2, HIDDEN, 3 * HIDDEN, s=HIDDEN**-0.5),
            "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "attend": draw(2 * HIDDEN, s=0.1),
            "out": draw(2 * HIDDEN, s=0.3),
            "bias": np.zeros(1, np.float32),
        }

    def inputs(self, block: Block) -> np.ndarray:
        begin = np.cumsum(block.gram_counts) - block.gram_counts
        pooled = np.add.reduceat(self.p["char"][block.grams], begin, axis=0) if block.distinct else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][block.word_bucket], pooled * np.float32(0.25)], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What the inputs add to the gates in either direction; one more row for the end of short texts."""
        g = x[None] @ self.p["wx"] + self.p["b"]
        return np.concatenate([g, np.zeros((2, 1, 3 * HIDDEN), np.float32)], axis=1)

    def forward(self, gates: np.ndarray, windows: np.ndarray, keep: list | None = None):
        n, h = len(windows), np.zeros((2, len(windows), HIDDEN), np.float32)
        states = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
        inside = windows < gates.shape[1] - 1
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            x = np.stack([gates[0][windows[:, t]], gates[1][windows[:, back]]])
            g = h @ self.p["wh"]
            zr = _sigmoid(x[..., : 2 * HIDDEN] + g[..., : 2 * HIDDEN])
            z, r, gn = zr[..., :HIDDEN], zr[..., HIDDEN:], g[..., 2 * HIDDEN :]
            new = np.tanh(x[..., 2 * HIDDEN :] + r * gn)
            now = new + z * (h - new)
            here = np.stack([inside[:, t], inside[:, back]])[..., None]
            if not here.all():
                now = np.where(here, now, h)
            if keep is not None:
                keep.append((h, z, r, gn, new, here))
            h = now
            states[t, :, :HIDDEN], states[back, :, HIDDEN:] = h[0], h[1]
        a = states @ self.p["attend"]
        a = np.where(inside.T, a, np.float32(-1e9))
        a = np.exp(a - a.max(axis=0))
        a *= inside.T
        a /= np.maximum(a.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tn,tnh->nh", a, states)
        return pooled @ self.p["out"] + self.p["bias"][0], states, a, pooled

    def gradients(self, block: Block, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of some windows."""
        distinct, inverse = np.unique(windows, return_inverse=True)
        windows = inverse.reshape(windows.shape)
        padded = distinct[-1] == block.distinct
        distinct = distinct[:-1] if padded else distinct
        part = block.part(distinct)
        x = self.inputs(part)
        keep: list = []
        logit, states, a, pooled = self.forward(self.gates(x), windows, keep)
        d_logit = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        d_pooled = d_logit[:, None] * self.p["out"]
        d_a = np.einsum("nh,tnh->tn", d_pooled, states)
        d_a = a * (d_a - (a * d_a).sum(axis=0))
        d_states = a[..., None] * d_pooled[None] + d_a[..., None] * self.p["attend"]
        grad = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True), "attend": np.einsum("tn,tnh->h", d_a, states)}
        d_wh = np.zeros_like(self.p["wh"])
        d_gates = np.zeros((2, len(distinct) + 1, 3 * HIDDEN), np.float32)
        d_h = np.zeros((2, len(windows), HIDDEN), np.float32)
        turned = self.p["wh"].transpose(0, 2, 1)
        for t in reversed(range(WINDOW)):
            h, z, r, gn, new, here = keep[t]
            back = WINDOW - 1 - t
            d_h = d_h + np.stack([d_states[t, :, :HIDDEN], d_states[back, :, HIDDEN:]])
            d = np.where(here, d_h, 0)
            d_n = d * (1 - z) * (1 - new * new)
            d_z = d * (h - new) * z * (1 - z)
            d_r = d_n * gn * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_n * r], axis=2)
            d_x = np.concatenate([d_z, d_r, d_n], axis=2)
            d_wh += h.transpose(0, 2, 1) @ d_g
            np.add.at(d_gates[0], windows[:, t], d_x[0])
            np.add.at(d_gates[1], windows[:, back], d_x[1])
            d_h = np.where(here, d * z, d_h) + d_g @ turned
        d_gates = d_gates[:, : len(distinct)]
        d_in = (d_gates @ self.p["wx"].transpose(0, 2, 1)).sum(axis=0)
        grad |= {"wh": d_wh, "wx": x.T[None] @ d_gates, "b": d_gates.sum(axis=1, keepdims=True)}
        grad["word"], grad["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(grad["word"], part.word_bucket, d_in[:, :WORD_DIM])
        np.add.at(grad["char"], part.grams, np.repeat(d_in[:, WORD_DIM:] * np.float32(0.25), part.gram_counts, axis=0))
        return grad

    def logits(self, block: Block, start: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of windows, some at a time: gates are made for the words of ``SLAB`` windows, so memory doesn't follow the block."""
        out = [np.zeros(0, np.float32)]
        for a in range(0, len(row), SLAB):
            b = min(a + SLAB, len(row))
            there = np.zeros(block.distinct + 1, bool)
            there[block.words(start[a:b], row[a:b])] = True
            held = np.flatnonzero(there[:-1])
            number = np.full(block.distinct + 1, len(held), np.int32)
            number[held] = np.arange(len(held))
            gates = self.gates(self.inputs(block.part(held)))
            for k in range(a, b, CHUNK):
                some = slice(k, min(k + CHUNK, b))
                out.append(self.forward(gates, number[block.words(start[some], row[some])])[0])
        return np.concatenate(out)


def _log_odds(block: Block, y: np.ndarray, some: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds of the texts of label 1 for each word row and each 4-gram row."""
    held = {"word": np.zeros((2, WORD_ROWS)), "char": np.zeros((2, CHAR_ROWS))}
    for a in range(0, block.n, some):
        b = min(a + some, block.n)
        doc, word = np.repeat(np.arange(a, b), block.counts[a:b]), block.word[block.bounds[a] : block.bounds[b]]
        doc, word = np.divmod(np.unique(doc * block.distinct + word), max(block.distinct, 1))
        part = block.part(word)
        for name, of, bucket in (("word", doc, part.word_bucket), ("char", np.repeat(doc, part.gram_counts), part.grams)):
            rows = held[name].shape[1]
            of, bucket = np.divmod(np.unique(of * rows + bucket), rows)
            for label in (0, 1):
                held[name][label] += np.bincount(bucket[y[of] == label], minlength=rows)
    zeros, ones = (max(int((y == label).sum()), 1) for label in (0, 1))
    # as if PRIOR more texts, labelled as all are, held each word: words that were never seen get 0
    odds = lambda n: np.clip(np.log(n[1] / ones + PRIOR / len(y)) - np.log(n[0] / zeros + PRIOR / len(y)), -4, 4)
    return odds(held["word"]), odds(held["char"])


def train(block: Block, y: np.ndarray, epochs: int = 6, least_steps: int = 120, batch: int = 128, rate: float = 0.02, seed: int = 7) -> tuple[Network, float, float, float]:
    """A network, slope and intercept that turn its highest logit into a probability in the sample, and its lowest logit."""
    rng, net = np.random.default_rng(seed), Network(seed)
    start, row = block.windows(FIT_STRIDE)
    word, char = _log_odds(block, y)
    net.p["word"][:, 0], net.p["char"][:, 0] = word / 2, char / 4
    first = np.searchsorted(row, np.arange(block.n))
    hint = np.maximum(net.inputs(block)[:, [0, WORD_DIM]].sum(axis=1), 0)
    total = np.concatenate([[0], np.cumsum(hint[block.word])])
    begin = block.bounds[:-1][row] + start
    top = total[np.minimum(begin + WINDOW, block.bounds[1:][row])] - total[begin]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for _ in range(max(epochs, -(-least_steps * batch // len(y)))):
        best = _highest(top, row, first)
        order = rng.permutation(block.n)
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            grad = net.gradients(block, block.words(start[best[some]], row[best[some]]), y[some].astype(np.float32))
            step += 1
            for name, g in grad.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        top = net.logits(block, start, row)
    start, row = block.windows()
    highest = np.maximum.reduceat(net.logits(block, start, row), np.searchsorted(row, np.arange(block.n)))
    return net, *_calibrate(highest, y), float(highest.min())


def _highest(top: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of each row's highest window, the first of equals."""
    most = np.maximum.reduceat(top, first)
    at = np.flatnonzero(top == most[row])
    return at[np.searchsorted(row[at], np.arange(len(first)))]


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slightly regularised logistic regression on the logit."""
    logit = logit.astype(np.float64)
    a, b = 1.0, 0.0
    for _ in range(20):
        p = _sigmoid(a * logit + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * logit).sum() + 2 * (a - 1), (p - y).sum() + 0.1 * b])
        h = np.array([[(w * logit * logit).sum() + 2, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(h, g)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
    return max(a, 0.05), b


class Model:
    """What the tasks get: a trained network, or a constant where nothing could be learned."""

    def __init__(self, share: float, net: Network | None = None, slope: float = 1.0, intercept: float = 0.0, lowest: float = 0.0):
        self.share, self.net, self.slope, self.intercept, self.lowest = share, net, slope, intercept, lowest

    def scores(self, column: pa.Array) -> np.ndarray:
        """The score of each text of a column."""
        if self.net is None:
            return np.full(len(column), self.share)
        out = [np.zeros(0)]
        for _, data, offsets in blocks(column, BLOCK):
            block = Block(data, offsets)
            start, row = block.windows()
            top = np.maximum.reduceat(self.net.logits(block, start, row), np.searchsorted(row, np.arange(block.n)))
            top = np.where(block.counts > 0, top, self.lowest)
            out.append(_sigmoid(self.slope * top.astype(np.float64) + self.intercept))
        return np.concatenate(out)


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, size: int | None = None, total: int | None = None) -> tuple[DataFrame, float]:
    """``text, y`` of at most ``2 * rows`` rows outside the held-out fold, and label 1's share of all of them.

    For each label the ``rows`` ids that are least by a hash, among documents of at most ``size`` bytes. With ``total``
    an id gives one text (of several the greatest), and only as many as hold half of ``total`` bytes for each label.
    """
    mine = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    mine = mine.groupBy("id").agg(F.max("y").alias("y"))
    share = mine.agg(F.avg("y")).first()[0]
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    there = texts if size is None else texts.where(F.octet_length("text") <= size)
    if total is None:
        named = mine.join(there.select("id"), "id", "left_semi")
    else:
        named = mine.join(there.groupBy("id").agg(F.max(F.octet_length("text")).alias("bytes")), "id")
    each = [named.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    if total is not None:  # a running sum over the ``rows`` ids of a label
        so_far = F.sum("bytes").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
        each = [e.withColumn("bytes", so_far).where(F.col("bytes") <= total // 2).drop("bytes") for e in each]
    some = cut(each[0].union(each[1]))  # 2 * rows ids
    held = there.join(F.broadcast(some), "id")
    if total is not None:
        held = held.groupBy("id", "y").agg(F.max("text").alias("text"))
    held = held.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(2 * rows)  # ids may repeat
    return held.select("text", "y"), float(share or 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the sample, trained in one task: the driver holds neither the texts nor their words."""
    ship(docs.sparkSession)
    sample, share = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE, SAMPLE_BYTES, SAMPLE_TOTAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one partition, as it is limited: SAMPLE_TOTAL bytes of text at most
        if held:
            yield pa.record_batch([pa.array([pickle.dumps(_fitted(pa.Table.from_batches(held), share))], pa.binary())], ["model"])

    rows = sample.mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else Model(share)


def _fitted(held: pa.Table, share: float) -> Model:
    y = held.column("y").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return Model(share)
    net, slope, intercept, lowest = train(Block.joined(held.column("text")), y)
    return Model(share, net, slope, intercept + prior_shift(share, y), lowest)


def prior_shift(share: float, y: np.ndarray) -> float:
    """What a logit loses when label 1 is rarer among all rows than in the sample ``y``."""
    odds = lambda p: np.log(p / (1 - p))
    return float(odds(np.clip(share, 1e-4, 1 - 1e-4)) - odds(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: two tables and a few matrices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(sent.value.scores(batch.column(1)))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns."""
    sent, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(batch.column(text)) < threshold))

    return docs.mapInArrow(run, docs.schema)
