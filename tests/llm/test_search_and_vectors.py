from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from reliefgrid.llm import collision_links, k2_treap, qd_whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def ranked_by_hand(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(size for _, _, size in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for d, c, size in held:
            m = 75 + 25 * size * n // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in asked.items() if t in c
            )
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ITEM_SCHEMA = "item_id long, text string, doc_id long, score string"


def asked(rows):
    texts = [r["text"] for r in rows if r["text"]]
    items = [(0, "Same words here again and again"), (1, " ".join(texts[3].split()[:40]).upper()), (2, texts[170]), (3, "nothing-like-this \x00"),
             (4, ""), (5, None), (6, texts[20][:200]), (6, texts[20][:200]), (6, "two words"), (None, "two words"), (7, "x")]
    return [(i, t, 1, "clash") for i, t in items]


@pytest.mark.parametrize(("shard_docs", "shard_points", "sample", "block_bytes", "batch"), [
    (8192, 1 << 20, 16_384, 1 << 24, 64), (16, 1 << 20, 40, 1 << 24, 3), (64, 300, 16_384, 900, 64),
])
def test_ranked_search_as_by_hand(spark, docs, rows, monkeypatch, shard_docs, shard_points, sample, block_bytes, batch):
    for name, value in (("SHARD_DOCS", shard_docs), ("SHARD_POINTS", shard_points), ("SAMPLE_DOCS", sample), ("BATCH", batch)):
        monkeypatch.setattr(k2_treap, name, value)
    items = asked(rows)
    found = k2_treap.ranked_documents(docs, spark.createDataFrame(items, ITEM_SCHEMA), 20, block_bytes)
    by_hand = ranked_by_hand([(r["doc_id"], r["text"]) for r in rows], [(i, t) for i, t, *_ in items], 20)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == by_hand


def test_ranked_search_of_empty_tables(spark, docs):
    none, items = docs.limit(0), spark.createDataFrame([(1, "some words", 1, "")], ITEM_SCHEMA)
    assert k2_treap.ranked_documents(none, items).collect() == []
    assert k2_treap.ranked_documents(docs, items.limit(0)).collect() == []


def test_treap_gives_the_best_of_any_grid():
    rng = np.random.default_rng(3)
    for count, terms_, cols in ((1, 1, 1), (5, 3, 2), (400, 9, 70), (3000, 300, 40), (900, 2, 1000)):
        points = sorted({(int(r), int(c)) for r, c in zip(rng.integers(0, terms_, count), rng.integers(0, cols, count), strict=True)})
        values = rng.integers(0, 50, len(points))
        first = np.searchsorted([c for _, c in sorted(points, key=lambda p: p[1])], np.arange(cols + 1))
        order = sorted(range(len(points)), key=lambda i: points[i][1])
        ids = np.arange(cols) * 3
        shard = k2_treap.Shard(ids, first, np.array([points[i][0] for i in order]), values[order], terms_)
        for _ in range(10):
            asked_ = np.unique(rng.integers(0, terms_, 5))
            weights = rng.integers(0, 4, len(asked_))
            scores = Counter()
            for (r, c), v in zip(points, values.tolist(), strict=True):
                if r in asked_:
                    scores[c * 3] += v * int(weights[np.searchsorted(asked_, r)])
            best = sorted(((s, d) for d, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))
            assert sorted(shard.search(asked_, weights, 6, (0, 0)), key=lambda x: (-x[0], x[1])) == best[:6]
            if len(best) > 4:
                floor = best[4]
                above = [x for x in shard.search(asked_, weights, 6, floor)]
                assert set(best[:5]) <= set(above)


VECTORS = "vec_id long, embedding array<float>, label int, n long, component int, whitened double"


def with_clashes(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 1, 0.5) for i, v, label in rows], VECTORS).repartition(5)


BAD = [(900, None, 1), (901, [], 1), (902, [1.0, None, 0.0, 2.0], 1), (903, [1.0, float("nan"), 0.0, 2.0], 1), (904, [float("inf"), 0.0, 0.0, 1.0], 1)]


def check_whitening(spark, rows, count=32, rank=None):
    found = qd_whitening.whitening(with_clashes(spark, rows), count).collect()
    good = [(i, v) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    size = Counter(len(v) for _, v in good).most_common(1)[0][0]
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000) for i, v in good if len(v) == size]
    x = np.array([v for _, v in good])
    n, sums = len(x), x.sum(0)
    off = n * x - sums
    centred = off / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(count, size)
    rank = size if rank is None else rank
    assert len(found) == n * k and {r["component"] for r in found} == set(range(1, k + 1)) and {r["n"] for r in found} == {n}
    assert sorted((r["vec_id"], r["deviation"]) for r in found if r["component"] == 1) == sorted(
        (i, int(d)) for (i, _), d in zip(good, np.square(off).sum(1), strict=True)
    )
    error = {r["identity_error"] for r in found}
    assert len(error) == 1 and error.pop() < 1e-9
    place = {i: p for p, (i, _) in enumerate(good)}
    for c in range(1, k + 1):
        own = {r["vec_id"]: r for r in found if r["component"] == c}
        explained = {r["explained"] for r in own.values()}
        assert len(explained) == 1
        if c > rank:
            assert explained == {0.0} and {r["whitened"] for r in own.values()} == {None}
            continue
        assert explained.pop() == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
        if len(own) == n:  # ids do not repeat
            mine = np.array([own[i]["whitened"] for i in place])
            theirs = centred @ v[:, c - 1] / np.sqrt(e[c - 1])
            assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-7
    return found


def test_whitening_against_a_dense_solver(spark, monkeypatch):
    monkeypatch.setattr(qd_whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(qd_whitening, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.standard_normal((300, 40)) * np.linspace(1, 4, 40))]
    check_whitening(spark, rows + BAD + [(905, [1.0, 2.0], 1)])


def test_whitening_of_flat_directions_copies_and_few_rows(spark):
    rng = np.random.default_rng(6)
    flat = rng.standard_normal((50, 5)) * 9
    flat[:, 1], flat[:, 3] = 2.0, 0.0
    check_whitening(spark, [(i, v.tolist(), 0) for i, v in enumerate(flat)], rank=3)
    check_whitening(spark, [(i, rng.standard_normal(6).tolist(), 0) for i in range(4)], rank=3)
    same = [(i, [1.0, 2.0], 0) for i in range(3)]
    check_whitening(spark, same, rank=0)
    found = check_whitening(spark, [(i, v.tolist(), 0) for i, v in enumerate(flat)] + [(2, flat[2].tolist(), 0)], rank=3)
    assert len([r for r in found if r["vec_id"] == 2]) == 10
    assert qd_whitening.whitening(with_clashes(spark, same).limit(0)).collect() == []
    assert qd_whitening.whitening(with_clashes(spark, BAD)).collect() == []


@pytest.mark.parametrize("kind", ["random", "graded", "close", "equal", "short"])
def test_qd_values_and_twisted_directions(kind):
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    rows = {
        "random": rng.standard_normal((500, 48)), "graded": rng.standard_normal((500, 48)) * np.logspace(0, -8, 48),
        "close": np.diag(np.r_[np.full(16, 5.0), np.full(16, 5 + 1e-9), np.arange(1.0, 17.0)]) @ turn, "equal": 3 * turn,
        "short": rng.standard_normal((20, 48)),
    }[kind]
    r = np.linalg.qr(rows, mode="r")
    r = np.vstack((r, np.zeros((48 - len(r), 48))))
    values, vectors, _ = qd_whitening.components(r, len(rows), 32)
    truth = np.linalg.svd(rows, compute_uv=False)
    truth = np.append(truth, np.zeros(48))[:32] ** 2 / len(rows)
    solid = values > 0
    assert np.allclose(values, truth, rtol=1e-9, atol=1e-20)
    v = vectors[:, solid]
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-10
    assert np.abs(rows.T @ (rows @ v) / len(rows) - v * values[solid]).max() < 1e-11 * values.max()


def test_wide_deviations_stay_exact():
    x = np.array([[1_000_000 + 2**30, 1_000_000], [1_000_000, 1_000_000]])
    sums = [int(s) for s in x.sum(0)]
    assert qd_whitening.deviations(x, 2, sums).to_pylist() == [2**60, 2**60]
    assert qd_whitening.deviations(x * 8, 2, [8 * s for s in sums]).to_pylist() == [None, None]


def linked_by_hand(rows):
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows
            if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    names, above, n = [i for i, *_ in good], list(range(len(good))), [0] * len(good)

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for a in range(len(good)):
        for b in range(a):
            (_, u, lu), (_, v, lv) = good[a], good[b]
            if lu == lv and len(u) == len(v) and u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= 0.93:
                n[a], n[b] = n[a] + 1, n[b] + 1
                above[root(a)] = root(b)
    least = {}
    for k, i in enumerate(names):
        least[root(k)] = min(i, least.get(root(k), i))
    out = [(i, n[k], least[root(k)], i == least[root(k)]) for k, i in enumerate(names)]
    known = {id(g) for g in good}
    assert known
    bad = [(i, 0, i, True) for i, v, label in rows if not (
        label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v))]
    return sorted(out + bad)


def clustered(count, spread, seed, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((count // 4, dims))
    rows = []
    for i in range(count):
        v = centres[rng.integers(len(centres))] + rng.standard_normal(dims) * spread * rng.random()
        rows.append((i, [float(c) for c in v * rng.uniform(0.1, 9)], int(i % 7 > 1)))
    hot = rng.standard_normal(dims)
    rows += [(1000 + i, [float(c) for c in hot + rng.standard_normal(dims) * 0.1], 1) for i in range(60)]
    rows += [(2000 + i, [float(c) for c in hot], 1) for i in range(30)]
    rows += [(3000 + i, [0.0] * dims, 1) for i in range(3)] + [(3010, rows[0][1], None), (3011, rows[0][1][:3], 1), (3012, rows[0][1][:3], 1)]
    return rows


def test_links_of_vectors_as_by_hand(spark, monkeypatch):
    monkeypatch.setattr(collision_links, "HOT_COPIES", 8)
    rows = clustered(400, 0.4, 1) + BAD
    found = collision_links.linked_vectors(with_clashes(spark, rows))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect())) == linked_by_hand(rows)


def test_links_in_cells_and_parts(spark):
    """Labels of many blocks: cells over several tables, crowded ones in parts; links found are right and nearly all are found."""
    rows = clustered(500, 0.4, 2)
    found = {r["vec_id"]: r for r in collision_links.linked_vectors(with_clashes(spark, rows), block_rows=40).collect()}
    truth = linked_by_hand(rows)
    assert len(found) == len(truth)
    assert all(found[i]["n_links"] <= n for i, n, *_ in truth)
    assert sum(r["n_links"] for r in found.values()) >= 0.98 * sum(n for _, n, *_ in truth)
    assert {(i, found[i]["component_id"]) for i in range(2000, 2030)} == {(i, c) for i, _, c, _ in truth if 2000 <= i < 2030}


def test_links_do_not_depend_on_the_size_of_a_block(spark):
    """Pairs at the threshold, one label: the same rows whether one block holds the label or many."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        u = rng.standard_normal(24)
        w = rng.standard_normal(24)
        u, w = u / np.linalg.norm(u), w - (w @ u) / (u @ u) * u
        near = 0.931 * u + math.sqrt(1 - 0.931**2) * w / np.linalg.norm(w)
        rows += [(2 * i, [float(c) for c in u], 1), (2 * i + 1, [float(c) for c in near], 1)]
    truth = linked_by_hand(rows)
    for block_rows in (8_192, 100, 7):
        assert sorted(map(tuple, collision_links.linked_vectors(with_clashes(spark, rows), block_rows=block_rows).collect())) == truth


def test_links_of_repeated_ids_null_ids_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [0.0, 1.0], 2)]
    frame = with_clashes(spark, rows)
    assert sorted(map(tuple, collision_links.linked_vectors(frame).collect())) == [
        (1, 1, 1, True), (1, 1, 1, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert collision_links.linked_vectors(frame.limit(0)).collect() == []
    assert sorted(r["vec_id"] for r in collision_links.linked_vectors(with_clashes(spark, BAD)).collect()) == [900, 901, 902, 903, 904]


def test_counts_reach_their_recall():
    least = collision_links.least_collisions(collision_links.LINES, collision_links.MISS)
    p = collision_links.normal_cdf(collision_links.WINDOW) * 2 - 1
    missed = sum(math.comb(collision_links.LINES, c) * p**c * (1 - p) ** (collision_links.LINES - c) for c in range(least))
    assert missed <= collision_links.MISS and least > 5
