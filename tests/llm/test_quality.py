import math
import re
from bisect import bisect_right

import numpy as np
from corpus_tables import SF
from pyspark.sql import functions as F

from roadloom.llm import quality

SF_LARGER = SF.replace("0.001", "0.01")


def test_tree_finds_the_best_cuts():
    g, h = np.array([1.0, 1, 1, -2, -2, 3, 3, 3]), np.full(8, 10.0)
    leaves = quality.tree(g, h)
    assert len(set(leaves[:3])) == len(set(leaves[3:5])) == len(set(leaves[5:])) == 1 and leaves[3] < 0 < leaves[0] < leaves[5]


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(np.int64)
    single, paired = quality.Model(0.5).train(x, y, pairs=0), quality.Model(0.5).train(x, y, pairs=2)
    right = lambda m: np.mean((m.scores(x) >= 0.5) == y)
    assert right(single) < 0.65 and right(paired) > 0.9 and (0, 1) in paired.pairs


def test_features_by_hand():
    text = "Aa aa aa! b\nline\nline\n".encode()
    row = dict(zip(quality.FEATURES, quality.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]))
    assert np.isclose(row["log_words"], np.log1p(6)) and np.isclose(row["marks_per_word"], 1 / 6) and np.isclose(row["adjacent_repeats"], 1 / 6)
    assert np.isclose(row["distinct_words"], 5 / 6) and np.isclose(row["repeated_lines"], 1 / 3) and np.isclose(row["capitals"], 1 / 6)


def hand_features(text):
    """The features of a text, without arrays."""
    raw, n = text.encode(), len(text.encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    count, per_word, per_byte = len(words), max(len(words), 1), max(n, 1)
    among = lambda chars: sum(chr(c) in chars for c in raw)
    upper, lower = among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), among("abcdefghijklmnopqrstuvwxyz")
    return [
        math.log1p(count), n / per_word, upper / max(upper + lower, 1), among("!?") / per_word, among("*$%&#@^~=_<>\\/{}[]+") / per_byte, among("|") / per_word,
        sum(a == b for a, b in zip(words, words[1:])) / per_word, len(set(words)) / per_word, among("0123456789") / per_byte, among(".,;:") / per_word,
        among("\n") / per_word, sum(c >= 128 for c in raw) / per_byte, sum(len(w) <= 3 for w in words) / per_word, math.log1p(max(map(len, words), default=0)),
        (len(lines) - len(set(lines))) / max(len(lines), 1), sum(65 <= w[0] <= 90 for w in words) / per_word,
    ]


def test_scores_equal_additions_by_hand(shipped, docs, edge):
    model = quality.fit(docs, shipped.read.parquet(f"{SF}/labels.parquet"))
    for table in (docs, edge):
        rows = {(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()}
        want = []
        for i, text in rows:
            x = hand_features(text or "")
            logit = model.intercept + sum(t[bisect_right(e.tolist(), v)] for t, e, v in zip(model.tables, model.edges, x))
            logit += sum(t[bisect_right(model.coarse[a].tolist(), x[a]), bisect_right(model.coarse[b].tolist(), x[b])] for (a, b), t in zip(model.pairs, model.pair_tables))
            want.append((str(i), round(1 / (1 + math.exp(-logit)), 9)))
        assert {(str(r["doc_id"]), round(r["score"], 9)) for r in quality.score(table, model).collect()} == set(want)


def test_labels_of_the_held_out_fold_teach_nothing(shipped, docs):
    labels = shipped.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (sorted((r["doc_id"], r["score"]) for r in quality.score(docs, quality.fit(docs, x)).collect()) for x in (labels, turned))
    assert one == other


def test_held_out_accuracy(shipped):
    docs, labels = (shipped.read.parquet(f"{SF_LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_edges(shipped, edge, nothing, docs):
    labels = shipped.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality.score(nothing, model).collect() == [] and quality.keep(nothing, model).collect() == []
    assert {r["score"] for r in quality.score(edge, quality.fit(edge, labels.where("false"))).collect()} == {0.5}
    assert quality.keep(edge, model).columns == edge.columns
