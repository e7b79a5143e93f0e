import re
from collections import Counter

import numpy as np
from corpus_tables import SF, table

from roadloom.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def grams(w):
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def brute(docs, items):
    """(document, item) with a window of the item's length whose weighted similarity is 0.8 or more."""
    out = set()
    held = [(i, words(t), Counter(grams(words(t)))) for i, t in items]
    for d, text in docs:
        w = words(text)
        for i, item, want in held:
            if not item or len(item) > len(w):
                continue
            vocabulary = set(want)
            all_grams = [tuple(w[k : k + min(5, len(item))]) for k in range(len(w) - min(5, len(item)) + 1)]
            if not any(g in vocabulary for g in all_grams):
                continue
            m = len(item) - min(5, len(item)) + 1
            for a in range(len(w) - len(item) + 1):
                both = sum((Counter(all_grams[a : a + m]) & want).values())
                if both / (2 * m - both) >= 0.8:
                    out.add((d, i))
                    break
    return out


def test_equals_brute_force(shipped, docs):
    benchmark = shipped.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    rows = decontaminate.matches(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["doc_id"] for r in docs.collect()} - {d for d, _ in want})


def test_changed_passages(shipped):
    item = [f"w{k}" for k in range(60)]
    one, few, many = list(item), list(item), list(item)
    one[30] = "x"
    few[58] = few[59] = "x"
    for k in range(0, 60, 7):
        many[k] = "x"
    rows = [(1, "before " + " ".join(item).upper() + ". after"), (2, "a " * 200 + " ".join(one)), (3, " ".join(many)), (4, " ".join(few)), (5, " ".join(item[:40])), (6, " ".join(item[10:] + item[:10]))]
    docs, benchmark = table(shipped, rows), shipped.createDataFrame([(7, " ".join(item)), (8, "short item"), (9, None), (10, " ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, benchmark).collect()}
    assert got == brute(rows, [(7, " ".join(item)), (8, "short item")]) and (1, 7) in got and (2, 7) in got and (3, 7) not in got


def test_edges(shipped, edge, nothing):
    benchmark = shipped.createDataFrame([(1, "the same line of text here again"), (2, "one")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(edge, benchmark).collect())
    assert got == [(4, 2), (5, 2), (8, 1), (9, 1)]
    assert decontaminate.matches(nothing, benchmark).collect() == [] and decontaminate.clean(nothing, benchmark).collect() == []
    assert decontaminate.matches(edge, benchmark.where("false")).collect() == []
    assert decontaminate.clean(edge, benchmark.where("false")).count() == edge.count()


def test_items_in_chunks(shipped, docs, monkeypatch):
    benchmark = shipped.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.matches(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 4000)
    assert sorted(map(tuple, decontaminate.matches(docs, benchmark).collect())) == want


def test_matches_and_clean_agree_on_letters(shipped):
    rows = [(1, "ΟΔΥΣΣΕΥΣ ΚΑΙ Ο ΜΥΘΟΣ ΤΗΣ ΙΘΑΚΗΣ ΕΙΝΑΙ ΠΑΛΙΟΣ"), (2, "İSTANBUL IŞIK DIŞ KAPI İÇİN ILIK SU"), (3, "οδυσσευσ και ο μυθοσ της ιθακης ειναι παλιος"), (4, "ΣΑΣ. ΜΑΣ' ΤΟΥΣ"), (None, "straße STRASSE ǅ ǆ ﬁ"), (6, None)]
    docs = table(shipped, rows)
    items = shipped.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)] + [(9, "οδυσσεύς")], "item_id long, text string")
    leaked = {(r["doc_id"], r["text_hash"]) for r in decontaminate.matches(docs, items, with_hash=True).collect()}
    assert {i for i, _ in leaked} == {1, 2, 3, 4, None}
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [6]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()}
    assert {(1, 0), (1, 2), (3, 0), (3, 2)} <= found


def test_the_index_filters_and_loses_nothing():
    rng = np.random.default_rng(2)
    m, n = 56, 3000
    items = rng.integers(0, 1 << 63, (n, m)).astype(np.uint64)
    index = decontaminate.Index(decontaminate.simhash(items))
    other = decontaminate.simhash(rng.integers(0, 1 << 63, (1000, m)).astype(np.uint64))
    assert len(index.candidates(other)[0]) < 0.01 * 1000 * n  # of unrelated pairs
    near = items.copy()
    near[:, rng.permutation(m)[: m // 9]] = rng.integers(0, 1 << 63, (n, m // 9)).astype(np.uint64)  # as far as a qualifying window gets
    prints = decontaminate.simhash(near)
    differ = np.bitwise_count(prints[:, None, :] ^ index.prints[None, :300, :]).sum(axis=2)
    window, item = index.near(prints)
    assert {(w, i) for w, i in zip(window, item) if i < 300} == set(map(tuple, np.argwhere(differ <= decontaminate.RADIUS)))
    assert (window == item).sum() >= 0.999 * n
