"""Quality: a generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Each text is a row of ``FEATURES``. A feature's values fall into at most ``BINS`` bins of about equal counts in the
fit sample. Rounds of boosting go over the features in turn; each fits a tree of at most ``LEAVES`` leaves on the
feature's bins to what the model still misses and adds a small share of it to the feature's lookup table. Then the
pairs of features whose joint bins explain most of the rest get tables of their own in the same way. A score is the
logistic of an intercept plus one table entry for each feature and pair, so scoring is binning and additions on arrays.

The fit takes a bounded sample of labelled rows, ``SAMPLE`` of each label; their features are made in the tasks and only
these numbers go to the driver. Scoring covers all rows and whole texts.

Defined cases: null and blank texts have all counts 0 and are scored like any text; repeated rows are scored each; a
null id is not held out and never learned from; texts of any length are read whole, in a block of their own (some
twenty bytes a byte of text); equal values fall into one bin; labels that are null, or join no document, are left out; without rows
of both labels every text gets the share of label 1 (0.5 without any labels); an empty table gives an empty result;
other columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.columnar import SPACED, Words, blocks, mix
from roadloom.llm.toxicity import fold, labelled_sample, prior_shift

FEATURES = [
    "log_words", "bytes_per_word", "upper_share", "marks_per_word", "symbol_share", "pipes_per_word", "adjacent_repeats", "distinct_words",
    "digit_share", "stops_per_word", "lines_per_word", "foreign_share", "short_words", "longest_word", "repeated_lines", "capitals",
]
SAMPLE = 4000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
BINS, COARSE, LEAVES, PAIRS = 48, 12, 4, 8
ROUNDS, RATE, LEAST = 120, 0.15, 5.0
BLOCK = 1_000_000

_CLASS = np.zeros(256, np.uint8)  # of bytes: 0 other, then as named
_LOWER, _UPPER, _MARK, _SYMBOL, _PIPE, _DIGIT, _STOP, _LINE, _FOREIGN = range(1, 10)
for _k, _chars in ((_LOWER, "abcdefghijklmnopqrstuvwxyz"), (_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_MARK, "!?"), (_SYMBOL, "*$%&#@^~=_<>\\/{}[]+"), (_PIPE, "|"), (_DIGIT, "0123456789"), (_STOP, ".,;:"), (_LINE, "\n")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = _FOREIGN
_IN_LINE = np.ones(256, bool)
_IN_LINE[10] = False


def _distinct(words: Words, hashes: np.ndarray) -> np.ndarray:
    """The number of distinct words of each text."""
    with np.errstate(over="ignore"):
        key = mix(hashes + words.doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return np.bincount(words.doc[np.unique(key, return_index=True)[1]], minlength=words.n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text of a block."""
    words = Words(data, offsets, SPACED, lower=False)
    n, length, count = words.n, np.diff(offsets), words.counts
    byte = np.zeros((n, 10), np.int64)
    if len(data):
        some = np.flatnonzero(length)
        for k in range(1, 10):
            byte[some, k] = np.add.reduceat(_CLASS[data] == k, offsets[some], dtype=np.int64)
    hashes, width = words.hashes(), words.ends - words.starts
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1]))
    lines = Words(data, offsets, _IN_LINE, lower=False)
    per_word, per_byte = np.maximum(count, 1), np.maximum(length, 1)
    by_doc = lambda flag: np.bincount(words.doc[flag], minlength=n)
    longest = np.zeros(n, np.int64)
    some = np.flatnonzero(count)
    if len(some):
        longest[some] = np.maximum.reduceat(width, words.bounds[some])
    columns = [
        np.log1p(count), length / per_word, byte[:, _UPPER] / np.maximum(byte[:, _UPPER] + byte[:, _LOWER], 1), byte[:, _MARK] / per_word,
        byte[:, _SYMBOL] / per_byte, byte[:, _PIPE] / per_word, np.bincount(words.doc[same], minlength=n) / per_word, _distinct(words, hashes) / per_word,
        byte[:, _DIGIT] / per_byte, byte[:, _STOP] / per_word, byte[:, _LINE] / per_word, byte[:, _FOREIGN] / per_byte, by_doc(width <= 3) / per_word,
        np.log1p(longest), (lines.counts - _distinct(lines, lines.hashes())) / np.maximum(lines.counts, 1), by_doc(_CLASS[data[words.starts]] == _UPPER) / per_word,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def text_features(column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(FEATURES))), *(features(data, offsets) for _, data, offsets in blocks(column, BLOCK))])


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each column at most ``bins - 1`` cuts between different values."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)], axis=1)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf value of each bin of the best greedy tree on bins with sums ``g`` of gradients and ``h`` of curvatures."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) - 1 < leaves:
        best = (1e-6, -1)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                left, right = (gs[at] - gs[a], hs[at] - hs[a]), (gs[b] - gs[at], hs[b] - hs[at])
                gain = _gain(*left) + _gain(*right) - _gain(gs[b] - gs[a], hs[b] - hs[a])
                gain[(left[1] < LEAST / 4) | (right[1] < LEAST / 4)] = 0
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(at[k])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    value = [(gs[b] - gs[a]) / (hs[b] - hs[a] + 1.0) for a, b in zip(cuts[:-1], cuts[1:])]
    return np.repeat(value, np.diff(cuts))


def tree_pair(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values on a table of two features' bins: one cut of either, four leaves; and their gain."""
    sums = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h)]
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return np.zeros_like(g), 0.0
    parts = [[s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j]] for s in sums]
    total = sum(_gain(a, b) for a, b in zip(*parts)) - _gain(sums[0][-1, -1], sums[1][-1, -1])
    a, b = np.unravel_index(int(total.argmax()), total.shape)
    leaf = [(p[a, b]) / (q[a, b] + 1.0) for p, q in zip(*parts)]
    out = np.empty_like(g)
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = leaf
    return out, float(total[a, b])


class Model:
    """Bin edges, an intercept and lookup tables for features and pairs."""

    def __init__(self, share: float):
        self.share, self.intercept = share, 0.0
        self.edges: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Model:
        self.edges, self.coarse = bin_edges(x, BINS), bin_edges(x, COARSE)
        fine, rough = binned(x, self.edges), binned(x, self.coarse)
        self.intercept = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        logit = np.full(len(y), self.intercept)

        def rest() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-logit))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(rounds):
            for k, table in enumerate(self.tables):
                g, h = rest()
                add = RATE * tree(np.bincount(fine[:, k], g, len(table)), np.bincount(fine[:, k], h, len(table)))
                table += add
                logit += add[fine[:, k]]
        size = [len(e) + 1 for e in self.coarse]
        flat = {(a, b): rough[:, a] * size[b] + rough[:, b] for a, b in combinations(range(x.shape[1]), 2)}
        sums = lambda ab, v: np.bincount(flat[ab], v, size[ab[0]] * size[ab[1]]).reshape(size[ab[0]], size[ab[1]])
        g, h = rest()
        self.pairs = sorted(flat, key=lambda ab: -tree_pair(sums(ab, g), sums(ab, h))[1])[:pairs]
        self.pair_tables = [np.zeros((size[a], size[b])) for a, b in self.pairs]
        for _ in range(rounds // 3):
            for ab, table in zip(self.pairs, self.pair_tables):
                g, h = rest()
                add = RATE * tree_pair(sums(ab, g), sums(ab, h))[0]
                table += add
                logit += add.ravel()[flat[ab]]
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), self.share)
        fine, rough = binned(x, self.edges), binned(x, self.coarse)
        logit = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            logit += table[fine[:, k]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            logit += table[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-logit))


def _of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, y): their features and labels."""
    for batch in batches:
        values = list(text_features(batch.column(0)))
        yield pa.record_batch([pa.array(values, pa.list_(pa.float64())), batch.column(1)], ["features", "y"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample, share = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE)
    held = sample.mapInArrow(_of_texts, "features array<double>, y int").toArrow()  # 2 * SAMPLE rows of numbers
    x, y = held.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)), held.column("y").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return Model(share if len(y) else 0.5)
    model = Model(share).train(x, y)
    model.intercept += prior_shift(share, y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: the lookup tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(sent.value.scores(text_features(batch.column(1))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is ``threshold`` or more, with all their columns."""
    sent, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(text_features(batch.column(text))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
