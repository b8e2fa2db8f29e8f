"""Grid joins against brute force."""

from __future__ import annotations

import math
import random

import pytest

from reliefgrid.operators.nearby import nearest, radius_join


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def points(seed, n, crowded):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i < crowded:
            out.append((i, 3.1 + rng.random() * 0.01, 101.6 + rng.random() * 0.01))
        elif i % 7 == 0:
            out.append((i, rng.uniform(87, 90) * rng.choice([-1, 1]), rng.uniform(-180, 180)))
        elif i % 5 == 0:
            out.append((i, rng.uniform(-20, 20), rng.choice([-180, 180]) + rng.uniform(-1, 1) * 0.5 * rng.choice([0, 1])))
        else:
            out.append((i, rng.uniform(0, 7), rng.uniform(99, 120)))
    return [(i, lat, (lon + 180.0) % 360.0 - 180.0) for i, lat, lon in out]


@pytest.mark.parametrize("radius,group_rows,small", [(120.0, 10, False), (120.0, 20_000, None), (2500.0, 10, False), (900.0, 20_000, True)])
def test_radius_join_is_exact(spark, radius, group_rows, small):
    left, right = points(1, 150, 50), points(2, 200, 70)
    a = spark.createDataFrame(left, "l_id long, l_lat double, l_lon double")
    b = spark.createDataFrame(right, "r_id long, r_lat double, r_lon double")
    joined = radius_join(
        a, b, ("l_lat", "l_lon"), ("r_lat", "r_lon"), right_key="r_id", left_key="l_id", radius_km=radius,
        group_rows=group_rows, small_right=small,
    )
    found = [(r.l_id, r.r_id) for r in joined.collect()]
    expected = {(x[0], y[0]) for x in left for y in right if km(x[1:], y[1:]) <= radius}
    assert len(found) == len(set(found)) and set(found) == expected


def test_nearest_is_exact_with_shared_columns(spark):
    left, right = points(3, 120, 30), points(4, 160, 40)
    word = lambda i: f"w{i % 3}"
    a = spark.createDataFrame([(*x, word(x[0])) for x in left], "l_id long, l_lat double, l_lon double, word string")
    b = spark.createDataFrame([(*x, word(x[0])) for x in right], "r_id long, r_lat double, r_lon double, word string")
    got = {r.l_id: r.nearest_r_id for r in nearest(a, b, "l_id", ("l_lat", "l_lon"), "r_id", ("r_lat", "r_lon"), on=["word"], group_rows=7).collect()}
    for x in left:
        best = min((km(x[1:], y[1:]), y[0]) for y in right if word(y[0]) == word(x[0]))
        assert got[x[0]] == best[1]


def test_nearest_with_limit(spark):
    a = spark.createDataFrame([(1, 3.0, 101.0), (2, 60.0, 10.0)], "l_id long, l_lat double, l_lon double")
    b = spark.createDataFrame([(9, 3.1, 101.0)], "r_id long, r_lat double, r_lon double")
    rows = nearest(a, b, "l_id", ("l_lat", "l_lon"), "r_id", ("r_lat", "r_lon"), radii_km=(5.0, 25.0)).collect()
    assert [(r.l_id, r.nearest_r_id) for r in rows] == [(1, 9)]


@pytest.mark.parametrize("group_rows", [10, 20_000])
def test_every_row_has_its_own_radius(spark, group_rows):
    """Radii from nothing to half the globe, in one join."""
    left, right = points(5, 120, 30), points(6, 90, 20)
    rng = random.Random(7)
    radii = {i: rng.choice([0.0, 0.5, 3.0, 15.0, 60.0, 200.0, 900.0, 3000.0, 25000.0, None]) for i, *_ in right}
    a = spark.createDataFrame(left, "l_id long, l_lat double, l_lon double")
    b = spark.createDataFrame([(*r, radii[r[0]]) for r in right], "r_id long, r_lat double, r_lon double, reach double")
    for table in (b, b.where("reach is null"), b.limit(0)):
        known = {r.r_id for r in table.select("r_id").collect()}
        joined = radius_join(
            a, table, ("l_lat", "l_lon"), ("r_lat", "r_lon"), right_key="r_id", left_key="l_id", radius_column="reach", group_rows=group_rows
        ).select("l_id", "r_id").collect()
        expected = {(p[0], q[0]) for p in left for q in right if q[0] in known and radii[q[0]] is not None and km(p[1:], q[1:]) <= radii[q[0]]}
        assert len(joined) == len({tuple(r) for r in joined}) and {tuple(r) for r in joined} == expected
