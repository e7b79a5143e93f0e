import numpy as np
import pytest
from corpus_tables import SF, table
from test_simhash import LOWER, WORD

from roadloom.llm import similar


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def stay(rows):
    """Smallest id of each group, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    at = {}
    for k, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    out = list(range(len(rows)))

    def root(k):
        while out[k] != k:
            k = out[k]
        return k

    for k, s in enumerate(sets):
        for j in {j for x in s for j in at[x] if j < k} or ([j for j in range(k) if not sets[j]] if not s else []):
            if not s or 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                out[root(k)] = root(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    return sorted(min(g) for g in groups.values())


def test_near_copies_go_as_by_brute_force(shipped):
    docs = shipped.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in similar.deduplicate(docs).collect()) == stay(rows)


@pytest.mark.parametrize("stars, tile, sent", [(2, 2048, 100_000), (0, 5, 0)])
def test_edited_copies_and_common_lines(shipped, monkeypatch, stars, tile, sent):
    for name, value in (("STARS", stars), ("TILE", tile), ("BROADCAST_ROWS", sent)):
        monkeypatch.setattr(similar, name, value)
    rng = np.random.default_rng(5)
    line, rows = " ".join(f"line{k}" for k in range(12)), []
    for group in range(12):
        words = [f"w{v}" for v in rng.integers(0, 5000, int(rng.integers(3, 90)))]
        for _ in range(8):
            mine = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
                mine[at] = f"e{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(mine) + (" " + line if group % 2 else "")))
    got = sorted(r["doc_id"] for r in similar.deduplicate(table(shipped, rows)).collect())
    assert got == stay(rows)
    assert 12 <= len(got) < len(rows)


@pytest.mark.parametrize("sent", [100_000, 0])
def test_repeated_rows_and_pairs_that_stars_leave(shipped, monkeypatch, sent):
    monkeypatch.setattr(similar, "BROADCAST_ROWS", sent)
    monkeypatch.setattr(similar, "STARS", 1)
    words = [f"w{k}" for k in range(64)]
    chain = [words[k : k + 44] for k in range(0, 20, 2)]  # neighbours are similar, the ends aren't
    rows = [(k, " ".join(w)) for k, w in enumerate(chain)] + [(20, "another text of more than five words"), (21, None), (22, "")]
    rows = rows * 3 + [(30, rows[4][1])]
    assert sorted(r["doc_id"] for r in similar.deduplicate(table(shipped, rows)).collect()) == stay(rows) == [0, 20, 21]


@pytest.mark.parametrize("small", [1, 100])  # of 75 members: tiles, or all at once
def test_pairs_within_the_radius(monkeypatch, small):
    monkeypatch.setattr(similar, "SMALL", small)
    rng = np.random.default_rng(3)
    near = rng.integers(0, 1 << 62, 12).astype(np.uint64)[np.arange(150) % 12]
    for _ in range(20):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    keys = rng.integers(0, 2, (10, 150)) + (rng.integers(0, 3, (10, 150)) << 32)
    keys[0], keys[0, 75:] = 1 << 32, np.arange(75) * ((1 << 32) + 1)  # in the second group bands differ before the second
    keys[1, 75:] = 7
    band = np.repeat([0, 2], 75)
    rows = np.stack([np.repeat([5, 9], 75), np.r_[np.zeros(75, np.int64), np.arange(75) % 2], near.view(np.int64), np.arange(150), rng.integers(80, 110, 150), np.arange(150) % 7, band, *rng.integers(0, 4, (8, 150)), *keys])
    want = set()
    for i in range(150):
        for j in range(i):
            group, tile, _, _, n, component, at, *rest = zip(rows[:, i], rows[:, j])
            if group[0] != group[1] or component[0] == component[1] or 5 * min(n) < 4 * max(n) or (small == 1 and group[0] == 9 and tile[0] == tile[1]):
                continue
            halves = [(a >> shift & 0xFFFFFFFF, b >> shift & 0xFFFFFFFF) for a, b in rest[8:] for shift in (0, 32)]
            first = [a == b for a, b in halves].index(True)
            if int(near[i] ^ near[j]).bit_count() <= similar.RADIUS and 9 * sum(int(a ^ b).bit_count() for a, b in rest[:8]) <= sum(n) and first == at[0]:
                want.add((j, i))
    told = [(a, b) for x in similar._within_runs(rows) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
    assert set(told) == want and len(told) == len(want) and any(a >= 75 for a, _ in want) and any(a < 75 for a, _ in want)


def test_buckets_hold_nearly_all_pairs_of_the_similarity():
    rng = np.random.default_rng(8)
    n, common = 90, 80  # similarity 0.8
    missed, far = 0, 0
    for _ in range(400):
        held = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        one, other = held[:n], np.r_[held[:common], held[n : 2 * n - common]]
        keys = similar._bands(np.concatenate([one, other]), np.array([n, n]))
        prints = similar.simhash.bit_majority(np.concatenate([one, other]), np.array([n, n]))
        missed += not (keys[0] == keys[1]).any()
        far += int(prints[0] ^ prints[1]).bit_count() > similar.RADIUS
    assert missed == far == 0
