"""Log-probabilities of texts under a hidden Markov model, and under smoothed unigrams.

Tokens are the words between ASCII white space, A-Z lower-cased, and one end for each text. Counts of all tokens are
summed by Spark. The model emits symbols: the ``OWN`` most frequent words of the training texts and the end are symbols
of their own, all other words share ``CLASSES`` symbols by their last three bytes, and within a class a word has its
smoothed share of the class's count (an unseen word that of half an occurrence). Held-out texts have no part in it.

Baum-Welch runs from a start that a bounded sample gave (``START_ROWS`` different training texts of at most
``START_TOKENS``, by a hash of the text, so copies count once): in each round every partition adds up its expected counts
over all training texts, Spark sums them, and the driver gets one number per state and symbol. Rounds end when the
likelihood of the training texts gains less than ``SETTLED`` of itself, after ``ROUNDS`` at most. Texts are whole
sequences; of one longer than ``RUN`` only the states between its runs are kept and each run is passed again, so the
counts are exact and memory is bounded. Scores use the scaled forward recursion over whole texts.

A word's count is looked up where it stands if it is among the ``FREQUENT`` most frequent of the training texts (a table
of bounded size in each task) and by a join on word hashes for the rest, aggregated per text before the shuffle.

Defined cases: null text is empty (the end only); repeated rows count and are scored each; a null id is neither held
out nor learned from; without training texts every token has count 0; texts of any length are scored whole (a task holds
two bytes a token, and about ten bytes a byte of the text while it is read); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.columnar import Words, blocks, mix
from roadloom.llm.toxicity import fold
from roadloom.session import cut

FOLDS, HELD_OUT = 5, 1
STATES, OWN, CLASSES, FREQUENT = 8, 4096, 1024, 131_072
ROUNDS, SETTLED, RUN = 4, 1e-3, 65_536
START_ROWS, START_TOKENS, START_ROUNDS = 1500, 8192, 12
END = np.int64(-0x5851F42D4C957F2D)
GROUP = 400_000
#: Distinct words that a task gathers before it hands on their counts.
GATHERED = 250_000
SYMBOLS = OWN + 1 + CLASSES


def suffix_class(words: Words) -> np.ndarray:
    """The class of each word, from its last three bytes."""
    key = np.zeros(len(words.starts), np.uint64)
    for k in (3, 2, 1):
        at = words.ends - k
        key = (key << np.uint64(8)) | np.where(at >= words.starts, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mix(key) % np.uint64(CLASSES)).astype(np.int64)


def count_tokens(docs: DataFrame) -> DataFrame:
    """``word, class, trained, n`` of each distinct token hash: its class, its count in training texts and in all."""

    def merged(parts: list[np.ndarray]) -> np.ndarray:
        """Rows (word, class, trained, n) of distinct words; ``parts`` have them as columns."""
        held = np.concatenate(parts, axis=1)
        word, at, inverse = np.unique(held[0], return_index=True, return_inverse=True)
        return np.stack([word, held[1][at], *(np.bincount(inverse, held[k], len(word)).astype(np.int64) for k in (2, 3))])

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in rows], ["word", "class", "trained", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            trains = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            for first, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets)
                mine = trains[first : first + words.n]
                word, at, inverse, n = np.unique(words.hashes(), return_index=True, return_inverse=True, return_counts=True)
                trained = np.bincount(inverse[mine[words.doc]], minlength=len(word))
                kind = suffix_class(words)[at]
                parts.append(np.stack([np.append(word.view(np.int64), END), np.append(kind, 0), np.append(trained, mine.sum()), np.append(n, words.n)]).astype(np.int64))
                size += len(word) + 1
                if size > 2 * GATHERED:
                    parts = [merged(parts)]
                    size = parts[0].shape[1]
                    if size > GATHERED:
                        yield batch_of(parts[0])
                        parts, size = [], 0
        if parts:
            yield batch_of(merged(parts))

    trains = F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False)).alias("trains")
    rows = docs.select(trains, F.col("text").alias("text")).mapInArrow(run, "word long, class long, trained long, n long")
    return rows.groupBy("word").agg(F.max("class").alias("class"), F.sum("trained").alias("trained"), F.sum("n").alias("n"))


class Lexicon:
    """Totals, and counts and symbols of the frequent words. Its size is bounded."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("trained").alias("tokens"), F.count_if(F.col("trained") > 0).alias("distinct")).first()
        self.tokens, self.distinct = int(total["tokens"] or 0), int(total["distinct"] or 0)
        seen = counts.where("trained > 0")
        level = F.floor(F.log2("trained") * 16).cast("int")
        levels = sorted(((r["level"], r["count"]) for r in seen.groupBy(level.alias("level")).count().collect()), reverse=True)  # a few hundred
        least, held = 1 << 20, 0
        for k, n in levels:
            held += n
            if held > FREQUENT:
                break
            least = k
        some = seen.where((level >= least) | (F.col("word") == int(END))).toArrow()  # FREQUENT + 1 rows at most
        word, kind, trained = (some.column(k).to_numpy() for k in range(3))
        order = np.argsort(word)
        self.word, self.count = word[order], trained[order]
        kind = kind[order]
        most = [k for k in np.lexsort((self.word, -self.count)).tolist() if self.word[k] != END][:OWN]
        self.symbol = OWN + 1 + kind
        self.symbol[most] = np.arange(len(most))
        self.symbol[self.word == END] = OWN
        mass, kinds = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for r in counts.groupBy("class").agg(F.sum("trained").alias("t"), F.count_if(F.col("trained") > 0).alias("d")).collect():  # CLASSES rows at most
            mass[OWN + 1 + r["class"]], kinds[OWN + 1 + r["class"]] = r["t"], r["d"]
        for k in np.flatnonzero(self.symbol <= OWN):  # out of their class: they are symbols of their own
            s = OWN + 1 + kind[k]
            mass[s], kinds[s] = mass[s] - self.count[k], kinds[s] - (self.count[k] > 0)
            mass[self.symbol[k]] = self.count[k]
        self.mass = mass
        self.class_total = np.where(np.arange(SYMBOLS) > OWN, mass + 0.5 * (kinds + 1), 1.0)
        self.unigram = float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its hash, whether it is frequent, its count if so, and its symbol."""
        word = words.hashes().view(np.int64)
        if not len(self.word):
            none = np.zeros(len(word), np.int64)
            return word, none > 0, none, OWN + 1 + suffix_class(words)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        hit = self.word[at] == word
        symbol = np.where(hit, self.symbol[at], 0)
        rare = np.flatnonzero(~hit)
        if len(rare):
            symbol[rare] = OWN + 1 + suffix_class(words)[rare]
        return word, hit, np.where(hit, self.count[at], 0), symbol


def encode(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Each text as symbols, with what its frequent words add to the scores and its other words' hashes and counts."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = ["doc_id", "held_out", "trains", "n_tokens", "n_known", "base", "share", "symbols", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        end_at = int(np.searchsorted(lex.word, END))
        end_count = int(lex.count[end_at]) if end_at < len(lex.word) and lex.word[end_at] == END else 0
        for batch in batches:
            for first, data, offsets in blocks(batch.column(3)):
                words = Words(data, offsets)
                word, hit, count, symbol = lex.read(words)
                by_doc = lambda x: np.bincount(words.doc, x, words.n)  # noqa: B023, E731
                known = by_doc(count > 0) + (end_count > 0)
                numerator = np.where(hit, np.log10(count + 0.5), 0.0)
                inside = symbol > OWN
                share = by_doc(np.where(inside, numerator - np.log10(lex.class_total[symbol]), 0.0))
                base = by_doc(numerator) + np.log10(end_count + 0.5) - (words.counts + 1) * lex.unigram
                ends = words.bounds[1:] + np.arange(1, words.n + 1)
                coded = np.insert(symbol, words.bounds[1:], OWN).astype("<u2")
                raw = coded.tobytes()
                starts = ends - words.counts - 1
                rare = np.flatnonzero(~hit)
                with np.errstate(over="ignore"):
                    key = mix(word[rare].view(np.uint64) + words.doc[rare].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                _, at, times = np.unique(key, return_index=True, return_counts=True)
                order = np.argsort(at)
                at, times = rare[at[order]], times[order]
                splits = pa.array(np.searchsorted(words.doc[at], np.arange(words.n + 1)).astype(np.int32))
                columns = [batch.column(k).slice(first, words.n) for k in range(3)]
                columns += [pa.array((words.counts + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(share)]
                columns += [pa.array([raw[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())]
                columns += [pa.ListArray.from_arrays(splits, pa.array(word[at])), pa.ListArray.from_arrays(splits, pa.array(times.astype(np.int32)))]
                yield pa.record_batch(columns, names)

    in_fold = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(in_fold, F.lit(False)).alias("held_out"), F.coalesce(~in_fold, F.lit(False)).alias("trains"), F.col("text").alias("text"))
    schema = "doc_id long, held_out boolean, trains boolean, n_tokens long, n_known long, base double, share double, symbols binary, rare array<long>, times array<int>"
    return cut(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


class Markov:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (k,), (k, k), (symbols, k)

    @classmethod
    def first(cls, mass: np.ndarray, seed: int = 3) -> Markov:
        rng = np.random.default_rng(seed)
        prior = (mass + 0.5) / (mass + 0.5).sum()
        emit = prior[:, None] * np.exp(rng.standard_normal((len(mass), STATES)))
        move = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, flat: np.ndarray, mass: np.ndarray) -> Markov:
        n = len(mass) * STATES
        prior = (mass + 0.5) / (mass + 0.5).sum()
        emit, move, start = flat[:n].reshape(len(mass), STATES) + 5.0 * prior[:, None], flat[n : n + STATES**2].reshape(STATES, STATES) + 0.1, flat[n + STATES**2 : n + STATES**2 + STATES] + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def forward(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: list | None = None, head: np.ndarray | None = None) -> np.ndarray:
        """Natural log-likelihood of each sequence; lengths fall, and are 1 at least.

        ``head`` has the states before a single sequence that goes on another; ``keep`` gets the states and scales.
        """
        total = np.zeros(len(starts))
        active = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), "right") if len(lengths) else []
        state = np.empty((0, STATES)) if head is None else head
        for t, n in enumerate(active):
            state = (state[:n] @ self.move if t or head is not None else np.tile(self.start, (n, 1))) * self.emit[symbols[starts[:n] + t]]
            scale = state.sum(axis=1)
            state /= scale[:, None]
            total[:n] += np.log(scale)
            if keep is not None:
                keep.append((state, scale))
        return total

    def expected(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts of emissions, transitions and starts over the sequences and their log-likelihood, in one flat array."""
        long = int(np.searchsorted(-lengths, -RUN))  # lengths fall
        flat = self._passed(symbols, starts[long:], lengths[long:])[0]
        for start, length in zip(starts[:long].tolist(), lengths[:long].tolist()):
            begins, heads, head = range(start, start + length, RUN), [], None
            runs = [(np.array([a]), np.array([min(RUN, start + length - a)])) for a in begins]
            for at, n in runs:
                heads.append(head)
                keep: list = []
                self.forward(symbols, at, n, keep, head)
                head = keep[-1][0]
            back = np.empty((0, STATES))
            for (at, n), head in zip(reversed(runs), reversed(heads)):
                more, back = self._passed(symbols, at, n, head, back)
                flat = flat + more
        return flat

    def _passed(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, head: np.ndarray | None = None, back: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Counts of whole sequences, or of one run between the states before it and what goes ``back`` from after it."""
        keep: list = []
        total = self.forward(symbols, starts, lengths, keep, head).sum()
        moves, back = np.zeros((STATES, STATES)), np.empty((0, STATES)) if back is None else back
        share, spoken = [], []
        for t in reversed(range(len(keep))):
            state, _ = keep[t]
            n, later = len(state), len(back)
            beta = np.ones((n, STATES))
            if later:  # back: emission times beta over scale, of the sequences that go on
                moves += state[:later].T @ back
                beta[:later] = back @ self.move.T
            share.append(state * beta)
            spoken.append(symbols[starts[:n] + t])
            back = self.emit[spoken[-1]] * beta / keep[t][1][:, None]
        begin = share[-1].sum(axis=0) if share and head is None else np.zeros(STATES)
        gamma, symbol = np.concatenate([np.zeros((0, STATES)), *share]), np.concatenate([np.zeros(0, np.int64), *spoken])
        emit = np.stack([np.bincount(symbol, gamma[:, k], len(self.emit)) for k in range(STATES)], axis=1)
        return np.concatenate([emit.ravel(), (moves * self.move).ravel(), begin, [total]]), back


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a column, and the start, length and row of each sequence, the longest first."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    symbols = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view("<u2").astype(np.int64)
    bounds = (bounds - bounds[0]) // 2
    start, length, row = bounds[:-1], np.diff(bounds), np.arange(len(column))
    order = np.argsort(-length, kind="stable")
    return symbols, start[order], length[order], row[order]


def groups(lengths: np.ndarray) -> Iterator[slice]:
    """Runs of sequences of about ``GROUP`` tokens."""
    total, a = np.cumsum(lengths), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + GROUP, "right")))
        yield slice(a, b)
        a = b


def train(rows: DataFrame, lexicon: Lexicon) -> Markov:
    """Baum-Welch over the encoded training texts."""
    learn = rows.where("trains").select("row", "symbols")
    named = F.xxhash64("symbols").alias("name")
    least = learn.where(F.length("symbols") <= 2 * START_TOKENS).select("row", named).groupBy("name").agg(F.min("row").alias("row")).orderBy("name").limit(START_ROWS)
    sample = learn.join(F.broadcast(least), "row").orderBy("name").select("symbols").toArrow()  # START_ROWS rows of bounded length
    model = Markov.first(lexicon.mass)
    symbols, start, length, _ = sequences(sample.column(0))
    for _ in range(START_ROUNDS if len(length) else 0):
        model = Markov.from_counts(sum(model.expected(symbols, start[g], length[g]) for g in groups(length)), lexicon.mass)
    before = None
    for _ in range(ROUNDS if lexicon.tokens else 0):
        sent = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1)
            for batch in batches:
                symbols, start, length, _ = sequences(batch.column(0))
                for g in groups(length):
                    total = total + sent.value.expected(symbols, start[g], length[g])
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], ["at", "value"])

        summed = learn.select("symbols").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # STATES * SYMBOLS rows
        flat = np.zeros(STATES * (SYMBOLS + STATES + 1) + 1)
        flat[summed.column("at").to_numpy()] = summed.column("value").to_numpy()
        model = Markov.from_counts(flat, lexicon.mass)
        if before is not None and flat[-1] - before < SETTLED * abs(flat[-1]):
            break
        before = flat[-1]
    return model


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    counts = cut(count_tokens(docs))
    lexicon = Lexicon(counts)
    rows = encode(docs, lexicon)
    sent = docs.sparkSession.sparkContext.broadcast(train(rows, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, start, length, row = sequences(batch.column(batch.num_columns - 1))
            out = np.zeros(batch.num_rows)
            for g in groups(length):
                out[row[g]] = sent.value.forward(symbols, start[g], length[g]) / np.log(10)
            yield pa.record_batch([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "path"])

    held = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "share"]
    paths = rows.select(*held, "symbols").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, path double")
    rare = rows.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    trained = F.coalesce("trained", F.lit(0))
    met = rare.join(counts.where("trained > 0").select("word", "trained"), "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(trained + 0.5)).alias("more"), F.sum(F.when(trained > 0, F.col("times")).otherwise(0)).alias("known"))
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return paths.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("path") + F.col("share") + more).alias("score"),
    )
