"""Zones against brute force: names by zone, covering zones, alerts and display, with joins dealt by pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reliefgrid.operators import nearby, zones
from test_nearby import km, points

PLACES = "destination_id long, destination_name string, lat double, lon double, continuous_pressure double"
ZONES = "key string, nama string, daerah string, lat double, lon double, radius_m long"


def tables(spark, names, shared):
    """Places of which many share a name, and zones of which some share a key; null names, keys and radii among them."""
    rng = random.Random(11)
    spots = [(i, rng.choice(names), lat, lon, rng.choice([0.5, 1.0, 2.0])) for i, lat, lon in points(8, 160, 60)]
    rings = [
        (f"Z{i % shared}" if i % 9 else None, "zone", "", lat, lon, rng.choice([500, 20_000, 90_000, 400_000, None]))
        for i, lat, lon in points(9, 120, 40)
    ]
    return spots, rings, spark.createDataFrame(spots, PLACES), spark.createDataFrame(rings, ZONES)


def held(spot, ring):
    return ring[5] is not None and km(spot[2:4], ring[3:5]) <= ring[5] / 1000.0


@pytest.mark.parametrize("names,shared,block", [
    ([f"n{i}" for i in range(9)] + [None], 70, 3), ([f"n{i}" for i in range(100)], 1000, 3_000), (["one", None], 1000, 4),
])
def test_names_of_zones(spark, monkeypatch, names, shared, block):
    monkeypatch.setattr(nearby, "BLOCK_ROWS", block)
    monkeypatch.setattr(zones, "BLOCK_ROWS", block)
    monkeypatch.setattr(nearby, "TASK_PAIRS", 500)
    spots, rings, places, circles = tables(spark, names, shared)
    expected = {(r[0], s[1]) for s in spots for r in rings if s[4] >= 1.0 and held(s, r)}
    for group_rows in (50, 20_000):
        found = [tuple(r) for r in zones.watched_names(places, circles, group_rows).select("z_key", "p_name").collect()]
        assert len(found) == len(set(found)) and set(found) == expected
        lists = zones.watch_list(places, circles, group_rows).collect()
        keyed = sorted(r[0] for r in rings if r[0] is not None and any(k == r[0] for k, _ in expected))
        assert sorted(r.key for r in lists) == keyed
        for r in lists:
            own = {n for k, n in expected if k == r.key}
            assert r.watch_count == len(own) and r.watch_districts == sorted(n for n in own if n is not None)


def test_pairs_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    """Two narrow sides in one crowded cell, of few bytes but many pairs."""
    monkeypatch.setattr(nearby, "TASK_PAIRS", 10_000)
    monkeypatch.setattr(nearby, "BLOCK_ROWS", 50)
    left, right = [(i, 3.0 + i * 1e-5, 101.0) for i in range(400)], [(i, 3.0, 101.0 + i * 1e-5) for i in range(400)]
    a = spark.createDataFrame(left, "l_id long, l_lat double, l_lon double")
    b = spark.createDataFrame(right, "r_id long, r_lat double, r_lon double")
    pairs = nearby.radius_join(
        a, b, ("l_lat", "l_lon"), ("r_lat", "r_lon"), right_key="r_id", left_key="l_id", radius_km=5.0, small_right=False
    ).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in pairs.groupBy("task").count().collect()]
    assert sum(sizes) == 160_000 and len(sizes) >= 8 and max(sizes) <= 40_000


@pytest.mark.parametrize("group_rows", [10, 20_000])
def test_nearest_covering_zone(spark, group_rows):
    spots, rings, places, circles = tables(spark, ["a"], 1000)
    circles = circles.where("key IS NOT NULL").withColumn("reach", F.col("radius_m") / 1000.0)
    circles = circles.withColumnsRenamed({"lat": "z_lat", "lon": "z_lon"})
    found = nearby.nearest_covering(
        places, circles, "destination_id", ("lat", "lon"), "key", ("z_lat", "z_lon"), "reach", group_rows=group_rows
    )
    got = {r.destination_id: (r.key, r.dist_m) for r in found.collect()}
    expected = {}
    for s in spots:
        hits = [(km(s[2:4], r[3:5]), r[0]) for r in rings if r[0] is not None and held(s, r)]
        if hits:
            expected[s[0]] = min(hits)
    assert set(got) == set(expected)
    for i, (dist, key) in expected.items():
        assert got[i][0] == key and got[i][1] == pytest.approx(dist * 1000.0, abs=1e-3)


def test_display_joins_only_zones_that_no_watch_shows(spark, monkeypatch):
    spots, rings, places, circles = tables(spark, [f"n{i}" for i in range(200)], 1000)
    circles, rings = circles.where("key IS NOT NULL"), [r for r in rings if r[0] is not None]
    alerts, watched = zones.hotspot_alerts(places, circles), zones.watch_list(places, circles)
    joined = []
    plain = zones.radius_join

    def seen(left, right, *args, **kwargs):
        joined.append({r.z_key for r in right.collect()})
        return plain(left, right, *args, **kwargs)

    monkeypatch.setattr(zones, "radius_join", seen)
    shown = {tuple(r) for r in zones.display_zones(places, circles, alerts, watched).select("destination_id", "key", "is_alert").collect()}
    watch = {r[0] for r in rings if any(s[4] >= 1.0 and held(s, r) for s in spots)}
    assert watch and joined == [{r[0] for r in rings} - watch]
    alert = {}
    for s in spots:
        hits = [(km(s[2:4], r[3:5]), r[0]) for r in rings if held(s, r)]
        if hits:
            alert[s[0]] = min(hits)[1]
    expected = {(None, k, True) for k in watch}
    for s in spots:
        for r in rings:
            if r[0] not in watch and (km(s[2:4], r[3:5]) <= 150.0 or alert.get(s[0]) == r[0]):
                expected.add((s[0], r[0], alert.get(s[0]) == r[0]))
    assert shown == expected


def test_names_at_several_positions_are_not_made_distinct_pair_by_pair(spark):
    """Their positions meet a zone together, so that no task holds its pairs."""
    spots, rings, places, circles = tables(spark, [f"n{i}" for i in range(9)], 1000)
    circles, rings = circles.where("key IS NOT NULL"), [r for r in rings if r[0] is not None]
    for group_rows in (50, 20_000):
        names = zones.watched_names(places, circles, group_rows)
        found = [tuple(r) for r in names.collect()]
        assert len(found) == len(set(found)) and set(found) == {(r[0], s[1]) for s in spots for r in rings if s[4] >= 1.0 and held(s, r)}
        plan = names._jdf.queryExecution().optimizedPlan().toString()
        assert "z_key" in plan and not [line for line in plan.splitlines() if "Aggregate [" in line and "z_key" in line]


def test_blocks_grow_with_the_pairs(spark, monkeypatch):
    """Rows go to all blocks they meet: twice the rows are sent twice as often only while blocks are few."""
    monkeypatch.setattr(nearby, "BLOCK_ROWS", 50)
    monkeypatch.setattr(nearby, "BLOCKS", 4)
    monkeypatch.setattr(nearby, "TASK_PAIRS", 10_000)
    a = spark.createDataFrame([(i, 3.0 + i * 1e-5, 101.0) for i in range(400)], "l_id long, l_lat double, l_lon double")
    b = spark.createDataFrame([(i, 3.0, 101.0 + i * 1e-5) for i in range(400)], "r_id long, r_lat double, r_lon double")
    pairs = nearby.radius_join(
        a, b, ("l_lat", "l_lon"), ("r_lat", "r_lon"), right_key="r_id", left_key="l_id", radius_km=5.0, small_right=False
    ).withColumn("task", F.spark_partition_id())
    assert pairs.select("l_id", "r_id").distinct().count() == 160_000
    # each left row is sent to the tasks that hold its pairs: to two blocks, and not to eight
    assert pairs.groupBy("l_id").agg(F.count_distinct("task").alias("n")).agg(F.max("n")).first()[0] <= 2
    assert [nearby.block_side(n * 3_000.0**2) for n in (1, 4, 16, 400, 1e9)] == [3_000, 3_000, 6_000, 30_000, 50_000]
