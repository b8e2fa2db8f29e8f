"""Readers, sinks and streams on files."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reliefgrid import schemas
from reliefgrid.operators import multipliers, quality, survey
from reliefgrid.plans import queries
from reliefgrid.sources import landing, readers, sinks
from reliefgrid.streaming import feeds


def test_bom_and_null_text(spark, tmp_path):
    path = tmp_path / "ranks.csv"
    path.write_text("﻿Year,Month,Rank 1,Rank 2,Rank 3,Rank 4,Rank 5\n2023,March,KL,JOHOR,SABAH,PERAK,N/A\n2023,August,0,0,0,0,0\n", encoding="utf-8")
    raw = readers.csv_text(spark, str(path))
    assert raw.columns[0] == "Year"
    assert survey.search_ranks(raw).count() == 4


def test_typed_csv_and_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2024, "Q1", 'Kuala "L", x', 51.5)], schemas.OCCUPANCY)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert readers.csv_table(spark, str(tmp_path / "csv"), schemas.OCCUPANCY).count() == 1
    sinks.write_table(rows, str(tmp_path / "pq"), partition_by=["year"])
    assert readers.parquet_table(spark, str(tmp_path / "pq")).first().average_occupancy_rate_pct == 51.5


def test_json_documents(spark, tmp_path):
    four = {"type1_output": 1.5, "type1_gva": 0.8, "type2_output": 2.6, "type2_gva": 1.3}
    doc = {"metadata": {"description": "x"}, "2021": {"year": 2021, "composite_tourism": {f"{k}_multiplier": v for k, v in four.items()},
           "sectors": {"accommodation": {"code": 94, "name": "A", "dosm_name": "P", **four}}}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    sectors, total = multipliers.from_json(readers.multiplier_json(spark, str(tmp_path / "m.json")))
    assert (sectors.first().year, sectors.first().type2_output, total.first().type1_output_multiplier) == (2021, 2.6, 1.5)
    routes = {"A-B": {"corridor_name": "c", "mode": "rail", "travel_time_mins": 52, "fare_rm": 7.5, "waypoints": [[5.4, 100.3], [4.8, 100.7]]}}
    (tmp_path / "r.json").write_text(json.dumps(routes))
    table = readers.route_json(spark, str(tmp_path / "r.json"))
    assert [p.lat for p in table.first().waypoints] == [5.4, 4.8]
    sinks.write_routes(table, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().waypoints == [[5.4, 100.3], [4.8, 100.7]]
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.json_records(spark, str(tmp_path / "list.json"), "a int").count() == 2


def test_snapshot_tolerates_a_missing_source(spark, tmp_path):
    tables, failures = readers.read_available({
        "ok": lambda: readers.land(spark.range(3).toDF("a"), str(tmp_path / "landed")),
        "gone": lambda: spark.read.parquet(str(tmp_path / "missing")),
    })
    assert tables["ok"].count() == 3 and list(failures) == ["gone"]


def test_report_folder(spark, tmp_path):
    (tmp_path / "AOR_2023.txt").write_text("Johor 1 55.5\nKedah 2")
    row = readers.report_texts(spark, str(tmp_path)).first()
    assert (row.file_name, row.text) == ("AOR_2023.txt", "Johor 1 55.5\nKedah 2")


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "ts timestamp, k string, value double").coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_bounded(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], "ts timestamp, k string, value double").schema
    _write(spark, source, [(datetime(2024, 1, 1, 5), "a", 10.0), (datetime(2024, 1, 5, 5), "a", 1.0)])
    stream = lambda: feeds.daily_mean(feeds.file_stream(spark, source, schema, 1), ["k"])
    feeds.run_available(stream(), out).awaitTermination()
    # one row too late for its closed day, one for a day still open, and one that moves the watermark on
    _write(spark, source, [(datetime(2024, 1, 1, 9), "a", 99.0), (datetime(2024, 1, 5, 9), "a", 3.0), (datetime(2024, 1, 9), "a", 7.0)])
    feeds.run_available(stream(), out).awaitTermination()
    got = {str(r.window_start.date()): (r.mean_value, r.row_count) for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01": (10.0, 1), "2024-01-05": (2.0, 2)}


def test_batch_sink_keeps_the_latest_status(spark, tmp_path):
    seen = {}
    _write(spark, str(tmp_path / "in"), [(datetime(2024, 1, 1), "a", 1.0), (datetime(2024, 1, 1, 3), "b", 3.0)])
    stream = feeds.daily_mean(feeds.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "ts timestamp, k string, value double").schema), ["k"])
    feeds.run_batches(stream, str(tmp_path / "ck"), lambda df, epoch: seen.update({r.k: r.mean_value for r in df.collect()})).awaitTermination()
    assert seen == {"a": 1.0, "b": 3.0}


def test_rules_are_observed(spark):
    from pyspark.sql import Observation

    rows = spark.createDataFrame([(1.0,), (-1.0,)], "v double")
    watch = Observation("checks")
    rules = {"v positive": F.col("v") > 0}
    quality.observed(rows, watch, rules).count()
    assert watch.get == {"row_count": 2, "v_positive": 1}


FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]


def test_plans_stay_in_the_jvm_without_pair_products(spark):
    for name in ["bottleneck_diagnosis", "state_rollup", "within_radius", "watch_zones", "lag_features", "occupancy_lines", "market_matrix"]:
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not [f for f in FORBIDDEN if f in plan], name


def test_scan_is_pruned(spark):
    plan = queries()["bottleneck_diagnosis"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan


def test_stream_queries_read_a_file_or_a_folder_of_parts(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    parts = tmp_path / "parts"
    for name in ("events", "lineitem", "supplier", "orders", "customer", "nation", "part", "region", "partsupp"):
        try:
            spark.read.parquet(f"{source}/{name}.parquet").repartition(3).write.parquet(str(parts / f"{name}.parquet"))
        except AnalysisException:
            assert name == "partsupp"
    for name in ("stream_daily_mean", "stream_live_status"):
        one, many = (sorted(map(tuple, queries()[name](spark, d).collect())) for d in (source, str(parts)))
        assert one and [r[:2] for r in one] == [r[:2] for r in many]


def test_rolling_mean_of_a_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, d, h), "k", float(d * h)) for d in range(1, 9) for h in (1, 5)]
    _write(spark, str(tmp_path / "in"), rows)
    schema = spark.createDataFrame([], "ts timestamp, k string, value double").schema
    stream = feeds.rolling_mean(feeds.file_stream(spark, str(tmp_path / "in"), schema), ["k"], days=3)
    feeds.run_available(stream, str(tmp_path / "out")).awaitTermination()
    got = {r.window_start: (round(r.mean_value, 9), r.row_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = feeds.rolling_mean(spark.createDataFrame(rows, schema), ["k"], days=3).collect()
    want = {r.window_start: (round(r.mean_value, 9), r.row_count) for r in batch}
    assert len(got) >= 4 and all(want[k] == v for k, v in got.items())
    hand = [v for t, _, v in rows if datetime(2024, 1, 2) <= t < datetime(2024, 1, 5)]
    assert want[datetime(2024, 1, 2)] == (round(sum(hand) / len(hand), 9), len(hand))


def test_a_broken_landing_is_not_read(spark, tmp_path):
    folder, good = str(tmp_path / "land"), spark.range(5).toDF("a")
    with pytest.raises(FileNotFoundError):
        landing.last_snapshot(spark, folder, good.schema)
    assert landing.commits(spark, folder).count() == 0
    read, broken = landing.fetch_or_last(spark, folder, lambda: good, good.schema)
    assert broken is None and read.count() == 5
    half = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("gone")).cast("long")).otherwise(F.col("id")).alias("a"))
    read, broken = landing.fetch_or_last(spark, folder, lambda: half, good.schema)
    assert broken and read.count() == 5 and landing.commits(spark, folder).count() == 1
    read, broken = landing.fetch_or_last(spark, folder, lambda: spark.read.parquet(f"{folder}/nowhere"), good.schema)
    assert broken == "PATH_NOT_FOUND" and read.count() == 5
    landing.land_snapshot(spark.range(7).toDF("a"), folder)
    assert landing.last_snapshot(spark, folder, good.schema).count() == 7


def test_differences_of_tables(spark):
    left = spark.createDataFrame([(k, f"v{k}", None if k % 2 else 1.0) for k in range(300)], "k long, v string, x double")
    assert quality.differences(left, left.repartition(7), ["k"], buckets=16).count() == 0
    right = left.where("k <> 5").withColumn("x", F.when(F.col("k") == 8, F.lit(None)).otherwise(F.col("x"))).union(
        spark.createDataFrame([(900, "new", 1.0)], left.schema))
    assert {(r.k, r.change) for r in quality.differences(left, right, ["k"], buckets=16).collect()} == {(5, "removed"), (8, "changed"), (900, "added")}
    assert quality.differences(left.limit(0), left.limit(0), ["k"]).count() == 0
    assert quality.differences(left, left.limit(0), ["k"]).count() == 300
