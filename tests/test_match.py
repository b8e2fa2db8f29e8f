"""Matching against a row-by-row brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from test_nearby import km

from reliefgrid.functions.geo import RAIL_LINES
from reliefgrid.operators import match
from reliefgrid.operators.explain import attribution_long, dominant_parts, explanation, simulate_policy
from reliefgrid.operators.match import match_all, prepare_places

ARCH = ["arch_heritage", "arch_nature", "arch_beach", "arch_food", "arch_urban"]
SCHEMA = (
    "destination_id long, destination_name string, lat double, lon double, capacity_gap double, sustainable_capacity double, "
    "daily_demand_peak double, poverty_rate double, cc_ecology double, total_rooms double, poi_tags string, "
    + ", ".join(f"{a} double" for a in ARCH)
)


def rnd(x, k=0):
    return math.floor(x * 10**k + 0.5) / 10**k


def make(seed, n, spread, feasible=0.5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        cap = rng.uniform(2000, 20000)
        demand = cap * (rng.uniform(0.3, 0.88) if rng.random() < feasible else rng.uniform(0.95, 1.6))
        tags = rng.choice([None, "", " | ".join(rng.sample("abcdefgh", 3))])
        name = rng.choice(["Cameron", "Genting", "Town", "Bay", "Port"]) + (f" {i}" if rng.random() < 0.9 else "")
        rows.append((
            i, name, 4.0 + rng.uniform(-1, 1) * spread[0], 102.0 + rng.uniform(-1, 1) * spread[1], 1 - demand / cap, cap, demand,
            rng.uniform(0, 12), cap * rng.uniform(0.6, 2.5), rng.uniform(500, 9000), tags, *[rng.random() for _ in ARCH],
        ))
    return rows


def station(lat, lon):
    best = min(
        (km((lat, lon), s[1:]), o, line)
        for o, (line, s) in enumerate((line, s) for line, stops in RAIL_LINES.items() for s in stops)
    )
    return best[2] if best[0] <= 25 else None


def score(h, c):
    straight = km(h[2:4], c[2:4])
    mountain = any(k in x[1].lower() for x in (h, c) for k in ("cameron", "genting"))
    if mountain:
        circuity, speed = 1.75, 38
    elif straight > 120:
        circuity, speed = 1.32, 70
    elif straight > 60:
        circuity, speed = 1.35, 60
    elif straight > 25:
        circuity, speed = 1.30, 50
    else:
        circuity, speed = 1.25, 45
    dist, mins = rnd(straight * circuity, 1), max(15, rnd(straight * circuity / speed * 60 + 8))
    a, b = station(*h[2:4]), station(*c[2:4])
    rail = bool(a and b and straight >= 15)
    if rail:
        mins = max(20, rnd(straight * 1.25 / 75 * 60 + 18 + (30 if a != b else 0)))
    u, v = h[11:16], c[11:16]
    cos = sum(x * y for x, y in zip(u, v)) / math.sqrt(sum(x * x for x in u)) / math.sqrt(sum(x * x for x in v))
    s, t = set((h[10] or "").split(" | ")) - {""}, set((c[10] or "").split(" | ")) - {""}
    sim = cos if h[10] is None or c[10] is None or not (s or t) else 0.6 * cos + 0.4 * (len(s & t) / len(s | t) if s and t else 0)
    access = 100 * math.exp(-0.0075 * mins)
    access = rnd(min(100, access + 8) if rail else access, 1)
    prop = min(100, max(0, rnd(c[4] * 100, 1)))
    head, need = max(0, c[5] - c[6]), max(0, h[6] - h[5])
    absolute = min(100, max(0, rnd(head / need * 100, 1))) if need > 0 else (100 if head > 0 else prop)
    spare = rnd(0.5 * prop + 0.5 * absolute, 1)
    community = min(100, rnd(c[7] * 8.5 + 15, 1))
    eco = rnd((1 - min(1, max(0, (c[8] - c[6]) / max(1, c[8])))) * 100, 1)
    total = 0.3 * rnd(sim * 100, 1) + 0.2 * access + 0.25 * spare + 0.2 * community - 0.05 * eco
    final = rnd(max(0, rnd(min(100, max(0, total)), 1) - max(0, dist - 60) * 0.08), 1)
    return final, dist, c[4] > 0.10 and c[6] < c[8] and dist <= 350


def brute(rows, n):
    out = {}
    for h in rows:
        cands = [(c[0], *score(h, c)) for c in rows if c[0] != h[0] and c[1].strip().lower() != h[1].strip().lower()]
        pool = [c for c in cands if c[3]] or cands
        near = [c for c in pool if c[2] <= 180]
        pool = near if len(near) >= min(n, len(pool)) else pool
        out[h[0]] = sorted((-c[1], c[0]) for c in pool)[:n]
    return out


@pytest.mark.parametrize(
    "seed,n,spread,feasible,group_rows",
    [(1, 60, (0.6, 0.6), 0.5, 20_000), (2, 60, (2.5, 6.0), 0.2, 8), (3, 40, (25.0, 60.0), 0.1, 8), (4, 50, (0.05, 0.05), 0.6, 5), (5, 4, (30.0, 70.0), 0.0, 2),
     (6, 250, (1.5, 2.0), 0.0, 20_000), (8, 90, (12.0, 40.0), 0.0, 8)],
)
def test_match_equals_brute_force(spark, seed, n, spread, feasible, group_rows):
    rows = make(seed, n, spread, feasible)
    ready = prepare_places(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in match_all(ready, ready, top_n=3, group_rows=group_rows).collect():
        got.setdefault(r.h_id, []).append((-r.final_wsm_score, r.c_id))
    expected = brute(rows, 3)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in expected.items() if v}


def test_many_places_do_not_meet_all_in_reach(spark, monkeypatch):
    """Above ``group_rows`` places, feasible ones too are found by way of cells, and few of those in reach are scored."""
    monkeypatch.setattr(match, "_near_pairs", lambda *_: pytest.fail("all places in reach are scored"))
    met, descend = [], match.bounds.descend
    monkeypatch.setattr(match.bounds, "descend", lambda *a: met.append(descend(*a)) or met[-1])
    rows = make(12, 300, (0.4, 0.4), 0.7)
    ready = prepare_places(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in match_all(ready, ready, top_n=3, group_rows=20).collect():
        got.setdefault(r.h_id, []).append((-r.final_wsm_score, r.c_id))
    assert {k: sorted(v) for k, v in got.items()} == brute(rows, 3)
    assert len(met) == 2 and met[1].count() * match.bounds.LEAF_PLACES < 300 * 300 / 2


def test_match_invariants_and_explanations(spark):
    rows = make(9, 50, (1.0, 1.5), 0.6)
    ready = prepare_places(spark.createDataFrame(rows, SCHEMA))
    best = match_all(ready, ready, top_n=3).cache()
    assert best.where("h_id = c_id").count() == 0
    assert best.groupBy("h_id").count().agg(F.max("count")).first()[0] <= 3
    parts = attribution_long(best).groupBy("h_id", "c_id").agg(F.round(F.sum("points"), 1).alias("s"))
    assert best.join(parts, ["h_id", "c_id"]).where(F.abs(F.col("s") - F.col("final_wsm_score")) > 1e-9).count() == 0
    assert dominant_parts(best).where("dominant_driver IS NULL OR dominant_constraint IS NULL").count() == 0
    assert explanation(best).where("explanation NOT LIKE 'High compatibility%uplift.'").count() == 0
    same = simulate_policy(best)
    assert same.where("delta_score <> 0 OR baseline_score <> simulated_score").count() == 0
    lifted = simulate_policy(best, capacity_pct=50.0)
    assert lifted.where("delta_score < 0").count() == 0


def test_gates(spark):
    base = (0, "Hot", 4.0, 102.0, -0.5, 1000.0, 1500.0, 5.0, 900.0, 5000.0, None, 0.5, 0.5, 0.5, 0.5, 0.5)
    cands = [
        (1, "at gap", 4.1, 102.0, 0.10, 1000.0, 900.0, 5.0, 5000.0, 5000.0, None, 0.5, 0.5, 0.5, 0.5, 0.5),
        (2, "over gap", 4.1, 102.1, 0.11, 1000.0, 890.0, 5.0, 5000.0, 5000.0, None, 0.5, 0.5, 0.5, 0.5, 0.5),
        (3, "eco bound", 4.1, 102.2, 0.50, 1000.0, 500.0, 5.0, 500.0, 5000.0, None, 0.5, 0.5, 0.5, 0.5, 0.5),
    ]
    places = spark.createDataFrame([base, *cands], SCHEMA)
    ready = prepare_places(places)
    rows = match_all(ready.where("id = 0"), ready, top_n=3).collect()
    assert [r.c_id for r in rows] == [2]
    assert match.MIN_GAP == 0.10
