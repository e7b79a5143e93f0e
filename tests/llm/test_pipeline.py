import corpus_pipeline
import pytest
from corpus_tables import SF, table
from test_decontaminate import brute
from test_packing import check
from test_pii import base
from test_similar import stay

from roadloom.llm import packing, toxicity

SF_LARGER = SF.replace("0.001", "0.01")


def test_stages_do_their_work(shipped, tmp_path):
    docs = shipped.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        stage(shipped, docs, SF).write.parquet(str(tmp_path / name))
        docs = shipped.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept[name] = (before, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    before, after = kept["toxicity"]
    model = toxicity.fit(shipped.read.parquet(f"{SF}/documents.parquet"), shipped.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(shipped.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    assert sorted(i for i, _ in after) == sorted(i for i, p in scores.items() if not p)
    before, after = kept["near_dedup"]
    assert sorted(i for i, _ in after) == stay(before)
    before, after = kept["decontaminate"]
    leaked = {d for d, _ in brute(before, [tuple(r) for r in shipped.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])}
    assert sorted(i for i, _ in after) == sorted({i for i, _ in before} - leaked)
    before, after = kept["pii"]
    assert sorted(i for i, _ in before) == sorted(i for i, _ in after)
    texts = dict(after)
    assert all(texts[i] == t for i, t in before if not any(c.isdigit() or c == "@" for c in t or ""))
    assert not any(k in ("email", "phone", "card", "ip") for t in texts.values() for k, _, _ in base(t or ""))
    assert corpus_pipeline.STAGES[-1][0] == "packing"
    check(docs)


def test_run_equals_its_stages(shipped):
    rows = corpus_pipeline.run(shipped, SF)
    assert rows.columns[:5] == [c.split()[0] for c in packing.PIECES.split(", ")]
    assert rows.select("sequence_id").distinct().count() > 0


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "x y z")], [(1, None), (1, ""), (3, "tie " * 9), (4, "tie " * 9), (5, " ".join(f"w{k}" for k in range(30_000)))]])
def test_small_tables(shipped, rows):
    docs = table(shipped, [(0, "x"), *rows]).where("doc_id is null or doc_id > 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(shipped, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= len(rows)
    assert corpus_pipeline.STAGES[-1][1](shipped, docs, SF).where("start = 0").count() == len(rows)  # the first piece of each
