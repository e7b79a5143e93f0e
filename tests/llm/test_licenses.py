import re
from collections import Counter

from corpus_tables import table
from roadloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(docs):
    want = Counter((r["doc_id"], *base(r["text"])) for r in docs.select("doc_id", "text").collect())
    rows = licenses.scan(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == want
    for r in rows:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert r["labels"].split(",") == sorted(set(r["labels"].split(",")))
    return {r["doc_id"]: r for r in rows}


def test_base_places_equal_brute_force(docs):
    check(docs)


def test_edges(edge, nothing):
    check(edge)
    assert licenses.scan(nothing).collect() == []


def test_many_places_and_changed_notices(shipped):
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    rows = [
        (1, "Under the MIT License. " * 400 + "under the mit" + " license"), (2, "under the under the mit license mit license"), (3, notice.replace("modification", "any modification")),
        (4, "Apache License, Version 2.0; CC-BY-NC 4.0 and cc by nc cc by nc"), (5, "source and binary only"), (6, "under  the mit license"),
    ]
    found = check(table(shipped, rows))
    assert found[3]["labels"] == "bsd" and 0.75 <= found[3]["score"] < 1
    assert found[4]["labels"] == "apache-2,cc-by-nc" and found[5]["labels"] == ""


def possible(text):
    """For each template span the label and the least and greatest share that a longest alignment can have, by comparing words."""
    words, k, out = WORD.findall((text or "").translate(LOWER)), licenses.K, []
    at = {}
    for p in range(len(words) - k + 1):
        at.setdefault(tuple(words[p : p + k]), []).append(p)
    for number, (template, label) in enumerate([*licenses.PHRASES, *licenses.NOTICES, *licenses.TEXTS]):
        t = template.split()
        hits = {(p, q) for q in range(len(t) - k + 1) for p in at.get(tuple(t[q : q + k]), [])}
        chains, drift = [], max(licenses.SHIFT, len(t) // 4)
        for d in sorted({p - q for p, q in hits}):
            if chains and d - chains[-1][-1] <= licenses.SHIFT:
                chains[-1].append(d)
            else:
                chains.append([d])
        half = drift + 1 - drift // 2
        for chain in chains:
            low = chain[0]
            ranges = [range(low, chain[-1] + 1)] if chain[-1] - low <= drift else [range(low + x * half, low + (x + 2) * half) for x in range((chain[-1] - low) // half + 1)]
            for r in ranges:
                pairs = sorted({(p + i, q + i) for p, q in hits if p - q in r for i in range(k)})
                best = {}  # of each pair the longest alignment that ends there, and where such ones begin
                for p, q in pairs:
                    before = [best[x] for x in best if x[0] < p and x[1] < q]
                    most = max((n for n, _ in before), default=0)
                    best[p, q] = (most + 1, {b for n, bs in before if n == most for b in bs} or {p})
                grams = len({q for p, q in hits if p - q in r}) / (len(t) - k + 1)
                if best:
                    most = max(n for n, _ in best.values())
                    shares = [most / max(len(t), p - b + 1) for (p, _), (n, bs) in best.items() if n == most for b in bs]
                    out.append((label if number >= len(licenses.PHRASES) else "", min(grams, *shares), min(grams, max(shares))))
    return out


def test_labels_and_scores_equal_brute_force(shipped, docs):
    notice = licenses.NOTICES[9][0].split()
    mit = licenses.TEXTS[0][0].split()
    extra = [
        (9001, " ".join(f"{a} {b} {c} zz" for a, b, c in zip(notice, notice[1:], notice[2:]))), (9002, " ".join([*notice[:8], "really", *notice[8:]])), (9003, " ".join(notice[:7] + notice[8:])),
        (9004, " ".join(mit)), (9005, " ".join(mit[:60] + mit[66:100] + ["some", "more", "words"] + mit[100:])), (9006, " ".join(mit[:70])), (9007, " ".join(notice * 3)),
    ]
    table_ = table(shipped, extra + [(r["doc_id"], r["text"]) for r in docs.where("text is not null").orderBy("doc_id").limit(150).collect()])
    texts = {r["doc_id"]: r["text"] for r in table_.collect()}
    rows = {r["doc_id"]: r for r in licenses.scan(table_).collect()}
    for i, text in texts.items():
        spans, r = possible(text), rows[i]
        assert max([0, *(low for _, low, _ in spans)]) - 1e-9 <= r["score"] <= max([0, *(high for *_, high in spans)]) + 1e-9
        sure = {label for label, low, _ in spans if label and low >= licenses.VERIFIED} | set(filter(None, r["base_labels"].split(",")))
        may = {label for label, _, high in spans if label and high >= licenses.VERIFIED} | sure
        assert sure <= set(filter(None, r["labels"].split(","))) <= may
    assert rows[9001]["labels"] == "" and rows[9001]["score"] < 0.5
    assert rows[9002]["labels"] == rows[9003]["labels"] == rows[9007]["labels"] == "gpl"
    assert "mit" in rows[9004]["labels"].split(",") and rows[9004]["score"] == 1 and "mit" in rows[9005]["labels"].split(",")
    assert [x.split(":")[2] for x in rows[9006]["spans"].split(",")] == ["1.000"]  # the short notice, not the whole text
