import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
from corpus_tables import table
from pyspark.sql import functions as F

from roadloom.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def crc(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def check(docs):
    rows = [(r["doc_id"], WORD.findall((r["text"] or "").translate(LOWER))) for r in docs.select("doc_id", "text").collect()]
    count, ends = Counter(), 0
    for i, w in rows:
        if crc(i) not in (None, 1):
            count.update(w)
            ends += 1
    total = sum(count.values()) + ends
    scale = math.log10(total + 0.5 * (len(count) + (ends > 0) + 1))
    base = lambda w: sum(math.log10(count[x] + 0.5) - scale for x in w) + math.log10(ends + 0.5) - scale
    want = sorted(((i, crc(i) == 1, len(w) + 1, sum(count[x] > 0 for x in w) + (ends > 0), total, round(base(w), 5)) for i, w in rows), key=str)
    got = lm.score(docs).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got), key=str) == want
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    return got


def test_base_scores_and_gain(docs):
    rows = check(docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_frequent_table_and_join_agree(docs, monkeypatch):
    want = sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in lm.score(docs).collect())
    monkeypatch.setattr(lm, "FREQUENT", 50)
    assert sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in lm.score(docs).collect()) == want


def test_edges(edge, nothing):
    check(edge)
    assert lm.score(nothing).collect() == []


def small(seed):
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.random(s) + 0.1
    start, move, emit = draw(lm.STATES), draw(lm.STATES, lm.STATES), draw(6, lm.STATES)
    return lm.Markov(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_forward_equals_the_sum_over_paths(monkeypatch):
    monkeypatch.setattr(lm, "STATES", 3)
    model = small(0)
    symbols, starts, lengths = np.array([0, 3, 2, 5, 1, 1, 4]), np.array([0, 4, 6]), np.array([4, 2, 1])
    got = model.forward(symbols, starts, lengths)
    for k, (a, n) in enumerate(zip(starts, lengths)):
        total = 0.0
        for path in product(range(3), repeat=int(n)):
            p = model.start[path[0]] * model.emit[symbols[a], path[0]]
            for t in range(1, n):
                p *= model.move[path[t - 1], path[t]] * model.emit[symbols[a + t], path[t]]
            total += p
        assert math.isclose(got[k], math.log(total), rel_tol=1e-12)


def test_baum_welch_never_loses_likelihood(monkeypatch):
    monkeypatch.setattr(lm, "STATES", 3)
    rng, model = np.random.default_rng(5), small(1)
    lengths = np.array([40, 30, 30, 7, 1])
    starts, symbols = np.cumsum(lengths) - lengths, rng.integers(0, 6, lengths.sum())
    before = -np.inf
    for _ in range(8):
        now = model.forward(symbols, starts, lengths).sum()
        assert now >= before - 1e-9
        before = now
        assert math.isclose(model.expected(symbols, starts, lengths)[30], now)
        flat = model.expected(symbols, starts, lengths)
        emit, move, start = flat[:18].reshape(6, 3), flat[18:27].reshape(3, 3), flat[27:30]
        assert math.isclose(emit.sum(), lengths.sum()) and math.isclose(start.sum(), len(lengths)) and math.isclose(move.sum(), (lengths - 1).sum())
        model = lm.Markov(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_runs_of_a_long_text_count_as_one(monkeypatch):
    monkeypatch.setattr(lm, "STATES", 3)
    rng, model = np.random.default_rng(6), small(2)
    lengths = np.array([41, 30, 12, 1])
    starts, symbols = np.cumsum(lengths) - lengths, rng.integers(0, 6, lengths.sum())
    want = model.expected(symbols, starts, lengths)
    for run in (40, 12, 5, 1):
        monkeypatch.setattr(lm, "RUN", run)
        assert np.allclose(model.expected(symbols, starts, lengths), want)


def test_held_out_texts_teach_nothing(shipped, docs):
    want = {r["doc_id"]: r for r in lm.score(docs).collect()}
    changed = docs.withColumn("text", F.when(lm.fold(F.col("doc_id"), lm.FOLDS) == lm.HELD_OUT, F.concat(F.lit("another word "), F.reverse("text"), F.lit(" another" * 500))).otherwise(F.col("text")))
    got = {r["doc_id"]: r for r in lm.score(changed).collect()}
    learned = [i for i, r in want.items() if not r["held_out"]]
    assert learned and all(math.isclose(got[i]["score"], want[i]["score"], rel_tol=1e-9) and got[i]["base_score"] == want[i]["base_score"] for i in learned)
    assert all(got[i]["n_tokens"] != want[i]["n_tokens"] for i in want if want[i]["held_out"])


def test_score_equals_the_recursion_by_hand(shipped):
    """Every text's score from the trained tables, one token and state at a time."""
    rows = [(k, f"the cat sat on the mat number {k % 3} and the dog sat too") for k in range(30)] + [(31, None), (32, "unseen words only")]
    docs = table(shipped, rows)
    held: list = []
    keep = lm.train
    try:
        lm.train = lambda *a: held.append((keep(*a), a[1])) or held[-1][0]
        got = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
    finally:
        lm.train = keep
    model, lexicon = held[0]
    learned, count = [t or "" for i, t in rows if crc(i) != 1], Counter()
    for t in learned:
        count.update(t.split())
    for i, text in rows:
        words, total, state = (text or "").split(), 0.0, None
        for token in [*words, None]:
            if token is None:
                symbol, share = lm.OWN, 1.0
            else:
                w = lm.Words(np.frombuffer(token.encode(), np.uint8), np.array([0, len(token.encode())]))
                symbol, own = int(lexicon.read(w)[3][0]), count[token]
                share = 1.0 if symbol < lm.OWN else (own + 0.5) / lexicon.class_total[symbol]
                assert symbol < lm.OWN or own == 0  # all learned words are symbols of their own here
            p = [sum(state[a] * model.move[a, b] for a in range(lm.STATES)) if state else model.start[b] for b in range(lm.STATES)]
            p = [x * model.emit[symbol, b] for b, x in enumerate(p)]
            total += math.log10(sum(p)) + math.log10(share)
            state = [x / sum(p) for x in p]
        assert math.isclose(got[i], total, rel_tol=1e-9)
