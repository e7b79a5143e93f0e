import re

import numpy as np
import pyarrow as pa
import pytest
from corpus_tables import SF, table
from pyspark.sql import functions as F

from roadloom.llm import toxicity

SF_LARGER = SF.replace("0.001", "0.01")


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    texts = ["you are a fool and a knave", "short", "the quick brown fox " * 12]
    block = toxicity.Block.joined(pa.array(texts, pa.large_string()))
    start, row = block.windows()
    windows = block.words(start, row)
    y = rng.integers(0, 2, len(windows)).astype(np.float32)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grad = net.gradients(block, windows, y)

    def loss():
        z = net.logits(block, start, row).astype(np.float64)
        return np.mean(np.logaddexp(0, z) - y * z)

    for name in ("wx", "wh", "b", "attend", "out", "word", "char"):
        flat, g = net.p[name].reshape(-1), grad[name].reshape(-1)
        for k in np.argsort(-np.abs(g))[:3]:
            held = flat[k]
            flat[k] = held + 1e-3
            up = loss()
            flat[k] = held - 1e-3
            down = loss()
            flat[k] = held
            assert (up - down) / 2e-3 == pytest.approx(g[k], rel=0.03, abs=1e-5), name


def test_every_run_of_words_stands_in_a_window():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        block = toxicity.Block.joined(pa.array([" ".join(f"w{k}" for k in range(n))], pa.large_string()))
        start, row = block.windows()
        windows = block.words(start, row)
        assert set(windows.ravel()) - {block.distinct} == set(block.word.tolist()) and set(row) == {0}
        run = min(n, toxicity.WINDOW - toxicity.STRIDE + 1)
        held = [w.tolist() for w in windows]
        assert all(any(block.word[a : a + run].tolist() == w[k : k + run] for w in held for k in range(len(w))) for a in range(n - run + 1))


def pieces_of(text):
    """Words of a text, long ones cut, by hand."""
    out = []
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())):
        while len(w) > toxicity.LONGEST:
            out.append(w[: toxicity.LONGEST])
            w = w[toxicity.LONGEST - toxicity.GRAM + 1 :]
        out.append(w)
    return out


def hand_bucket(gram):
    key = 0
    for c in gram:
        key = (key << 9) | c
    return ((key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48) % toxicity.CHAR_ROWS


def hand_logit(net, text):
    """The highest logit over all windows of a text, one word, state and gate at a time."""
    words, p = pieces_of(text), {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs = []
    for w in words:
        marked = [1, *(c + 2 for c in w), 1]
        grams = [marked[k : k + 4] for k in range(max(1, len(marked) - 3))]
        grams = [g + [0] * (4 - len(g)) for g in grams]
        own = toxicity.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hashes()[0]
        inputs.append(np.concatenate([p["word"][int(own >> np.uint64(40)) % toxicity.WORD_ROWS], sum(p["char"][hand_bucket(g)] for g in grams) / 4]))
    sigmoid, h = (lambda x: 1 / (1 + np.exp(-x))), toxicity.HIDDEN
    best = -np.inf
    last = max(0, len(words) - toxicity.WINDOW)
    for a in sorted({*range(0, last, toxicity.STRIDE), last}):
        window = inputs[a : a + toxicity.WINDOW]
        states = []
        for d, order in ((0, window), (1, window[::-1])):
            state, seen = np.zeros(h), []
            for x in order:
                g, r = x @ p["wx"][d] + p["b"][d, 0], state @ p["wh"][d]
                z, reset = sigmoid(g[:h] + r[:h]), sigmoid(g[h : 2 * h] + r[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(g[2 * h :] + reset * r[2 * h :])
                seen.append(state)
            states.append(seen if d == 0 else seen[::-1])
        both = np.array([np.concatenate(s) for s in zip(*states)])
        weight = np.exp(both @ p["attend"])
        best = max(best, (weight / weight.sum()) @ both @ p["out"] + p["bias"][0])
    return best


def test_scores_equal_a_forward_pass_by_hand(shipped):
    docs, labels = (shipped.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = [(k, t) for k, t in enumerate(["a", "You FOOL, you!", "x" * 130 + " end", "\u6f22\u5b57" * 60, " ".join(f"word{k} and" for k in range(70))])]
    rows += [(100 + r["doc_id"], r["text"]) for r in docs.where("length(text) between 20 and 900").orderBy("doc_id").limit(8).collect()]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table(shipped, rows), model).collect()}
    for i, text in rows:
        want = 1 / (1 + np.exp(-(model.slope * hand_logit(model.net, text) + model.intercept)))
        assert got[i] == pytest.approx(want, abs=1e-4), i


def test_the_end_of_a_long_word_counts():
    stem = "x" * 40
    buckets = [toxicity.Block.joined(pa.array([stem + end], pa.large_string())).grams.tolist() for end in ("fool", "wise")]
    assert buckets[0] != buckets[1] and len(buckets[0]) == 43


def test_labels_of_the_held_out_fold_teach_nothing(shipped):
    docs, labels = (shipped.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()) for x in (labels, turned))
    assert one == other


def test_held_out_accuracy(shipped):
    docs, labels = (shipped.read.parquet(f"{SF_LARGER}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.9 * len(rows) and sum(r["predicted"] and r["toxic"] for r in rows) >= 0.6 * sum(r["toxic"] for r in rows)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.score(docs, model).where("predicted = 0").count()


def test_edges(shipped, edge, nothing, docs):
    labels = shipped.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert toxicity.score(nothing, model).collect() == [] and toxicity.reject(nothing, model).collect() == []
    assert {r["score"] for r in toxicity.score(edge, toxicity.fit(edge, labels.where("false"))).collect()} == {0.0}
    assert toxicity.fit(nothing, labels).net is None


def test_sample_holds_its_bytes(shipped):
    rows = [(k, ("a" if k % 2 else "b") * (10 + k)) for k in range(1, 61)] + [(7, "again")] * 50
    docs, labels = table(shipped, rows), shipped.createDataFrame([(k, k % 2) for k in range(1, 61)], "doc_id long, toxic int")
    every, share = toxicity.labelled_sample(docs, labels, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, 100, 60_000, 10_000)
    learned = {r["doc_id"] for r in docs.where(toxicity.fold(F.col("doc_id"), toxicity.FOLDS) != toxicity.HELD_OUT).select("doc_id").distinct().collect()}
    assert len(every.collect()) == len(learned) and 0 < share < 1
    some, _ = toxicity.labelled_sample(docs, labels, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, 100, 60_000, 600)
    for y in (0, 1):
        size = sum(len(r["text"]) for r in some.collect() if r["y"] == y)
        assert 200 < size <= 300


def test_slabs_change_no_logit(monkeypatch):
    texts = [" ".join(f"w{k * j % 91}" for k in range(90 * j)) for j in range(1, 7)] + ["", "one word"]
    block, net = toxicity.Block.joined(pa.array(texts, pa.large_string())), toxicity.Network(3)
    start, row = block.windows()
    whole = net.logits(block, start, row)
    monkeypatch.setattr(toxicity, "SLAB", 7)
    monkeypatch.setattr(toxicity, "CHUNK", 3)
    assert np.allclose(whole, net.logits(block, start, row), atol=1e-6)


def test_the_driver_trains_nothing(shipped, monkeypatch):
    docs, labels = (shipped.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sample, share = toxicity.labelled_sample(docs, labels, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, toxicity.SAMPLE, toxicity.SAMPLE_BYTES, toxicity.SAMPLE_TOTAL)
    want = toxicity._fitted(sample.toArrow(), share)
    here = []
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: here.append(1))
    monkeypatch.setattr(toxicity.Block, "joined", lambda *a: here.append(1))
    model = toxicity.fit(docs, labels)
    assert not here and (model.slope, model.intercept, model.lowest) == pytest.approx((want.slope, want.intercept, want.lowest), rel=1e-3)
    assert all(np.allclose(model.net.p[k], want.net.p[k], atol=1e-3) for k in want.net.p)
