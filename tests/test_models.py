"""Forecast, impact and multipliers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from reliefgrid.operators import forecast, impact, multipliers, panel


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, len(forecast.FEATURES))) * rng.uniform(1, 50, len(forecast.FEATURES)) + 10
    y = x @ rng.normal(size=x.shape[1]) + rng.normal(size=200) * 5
    df = spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(x, y)], ", ".join(f"{c} double" for c in forecast.FEATURES) + ", actual_demand double")
    model = forecast.fit_volume(df, alpha=0.5)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 0.5 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    weights = np.array([model.weights[c] for c in forecast.FEATURES])
    assert np.allclose(weights * x.std(0), beta, rtol=1e-6, atol=1e-8)
    slopes = forecast.optimality(df, model, "actual_demand", model.margin()).collect()
    assert len(slopes) == len(forecast.FEATURES) + 1 and max(abs(r.gradient) for r in slopes) < 1e-8


def test_spike_fit_is_the_optimum(spark):
    """A sample that no plane separates, scored after an observation was used in the session."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, len(forecast.FEATURES)))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 0.3).astype(float)
    kinds = ", ".join(f"{c} double" for c in forecast.FEATURES) + ", is_spike double"
    df = spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(x, y)], kinds)
    seen = Observation("seen")
    df.observe(seen, F.count(F.lit(1)).alias("n")).count()
    model = forecast.fit_spike(df)
    probability = forecast.chance(model.margin())
    assert max(abs(r.gradient) for r in forecast.optimality(df, model, "is_spike", probability).collect()) < 1e-9
    assert len(model.steps) <= 8 and [k for k, *_ in model.steps] == list(range(1, len(model.steps) + 1))
    scored = forecast.model_scores(df, model, model).select("spike_raw_prob", "is_spike").toPandas()
    assert ((scored.spike_raw_prob > 0.5) == (scored.is_spike == 1.0)).mean() > 0.7
    with pytest.raises(ValueError, match="converged"):
        forecast.fit_spike(df, iterations=2)
    alone = forecast.fit_spike(df.where("is_spike = 1"))
    assert set(alone.weights.values()) == {0.0} and alone.intercept > 10


def test_elasticity_rules(spark):
    rows = [("Langkawi", "Kedah", m) for m in (1, 5, 9)] + [("Kuching", "Sarawak", 6), ("Samarahan", "Sarawak", 6), ("Tuaran", "Sabah", 5)]
    df = spark.createDataFrame(rows + [(None, "Sarawak", 6), ("Miri Kampar", None, 7), ("x", "Sarawak", None)], "destination_name string, state_name string, month_no int")
    out = forecast.with_rule_factors(df, forecast.rule_table(spark), F.lit(1.0))
    got = {(r.destination_name, r.state_name, r.month_no): (r.place_rule, pytest.approx(r.state_rule)) for r in out.collect()}
    assert [got[k] for k in rows] == [(1.16, 1.0), (1.0, 1.0), (0.86, 1.0), (1.0, 1.2), (1.0, 1.0), (1.0, 1.3)]
    assert got[None, "Sarawak", 6] == (1.0, 1.2) and got["Miri Kampar", None, 7] == (1.28, 1.0) and got["x", "Sarawak", None] == (1.0, 1.0)
    assert len(got) == len(rows) + 3


def test_rules_of_any_number(spark):
    """A thousand rules: names are looked up, not tested rule by rule; words may ask for the end of a name."""
    last = forecast.NAME_ENDS[1]
    rules = [([f"word{k:03d}"], [([1], 1.0 + k / 1000)]) for k in range(1000)] + [([f"7{last}"], [([1], 3.0)])]
    df = spark.createDataFrame([("a word500 and word017", "s", 1), ("word999", "s", 2), ("no 7", "s", 1), ("7 no", "s", 1), ("", "s", 1)],
                               "destination_name string, state_name string, month_no int")
    out = forecast.with_rule_factors(df, forecast.rule_table(spark, rules, []), F.lit(0.0))
    assert {r.destination_name: r.place_rule for r in out.collect()} == {
        "a word500 and word017": pytest.approx(1.017), "word999": 1.0, "no 7": 3.0, "7 no": 1.0, "": 1.0}


def test_holiday_proximity(spark):
    months = spark.createDataFrame([("2025-01",), ("2026-12",), ("2027-01",)], "month string")
    days = spark.createDataFrame([("2025-01-29",), ("2025-01-01",), ("2026-12-25",)], "holiday_date string").withColumn("holiday_date", F.to_date("holiday_date"))
    got = {r.month: (r.days_to_next, r.near_count) for r in panel.holiday_proximity(months, days).collect()}
    assert got == {"2025-01": (14, 2.0), "2026-12": (10, 1.0), "2027-01": (365, 0.0)}


def test_lags_take_the_default_before_the_panel(spark):
    cells = spark.createDataFrame([("x", "2025-01-01", 40.0), ("x", "2025-02-01", 50.0)], "state_key string, m string, aor double").select(
        "state_key", F.to_date("m").alias("month_start"), "aor")
    rows = spark.createDataFrame([("W.P. X", "2025-02"), ("X", "2025-04")], "state_name string, month string")
    got = {r.month: (r.aor_t1, r.aor_ma3) for r in panel.lag_features(rows, cells, F.lit(47.5)).collect()}
    assert got["2025-02"] == (40.0, pytest.approx((40 + 47.5 + 47.5) / 3)) and got["2025-04"] == (47.5, pytest.approx((47.5 + 50 + 40) / 3))


def test_calibration(spark):
    rows = spark.createDataFrame([(140.0, 0.2), (110.0, 0.1), (95.0, 0.6), (50.0, 0.9)], "s double, p double")
    assert [r[0] for r in rows.select(forecast.calibrated(F.col("s"), F.col("p"))).collect()] == [0.94, 0.78, 0.6, 0.2]


def test_mitigation_lowers_the_named_place(spark):
    risk = spark.createDataFrame([(1, "A", 14000.0, 10000.0, 140.0, 97.0, 4000.0), (2, "B", 13500.0, 10000.0, 135.0, 96.0, 3500.0)],
                                 "destination_id long, destination_name string, predicted_peak_volume double, base_capacity double, capacity_stress_pct double, "
                                 "spike_probability_pct double, excess_surge_volume double")
    named = spark.createDataFrame([("a", 3000.0)], "destination_name string, diverted double")
    first, second = forecast.rank_at_risk(risk, named, top_n=5).collect()
    assert (first.destination_name, second.destination_name, second.stress_pct, second.spike_prob_pct, second.recommended_diversion) == ("B", "A", 110.0, 55.0, 650.0)


def scenario(spark, visitors=2000.0, days=30, mode="domestic", pressure=0.5):
    return spark.createDataFrame([(visitors, days, 2.45, 386.73, mode, 9.0, 0.4, pressure)],
                                 "redirected_visitors_daily double, days_period int, alos double, spend_per_night double, tourism_mode string, "
                                 "candidate_poverty double, hotspot_poverty double, destination_pressure double")


def test_impact_goldens(spark):
    row = impact.impact(scenario(spark)).first()
    assert row.direct_spend_million_rm == pytest.approx(56.849) and row.total_economic_output_million_rm == pytest.approx(56.849 * 1.75, abs=2e-3)
    double = impact.impact(scenario(spark, 4000.0)).first()
    assert double.direct_spend_million_rm == pytest.approx(2 * row.direct_spend_million_rm, abs=2e-3)
    inbound = impact.impact(scenario(spark, mode="Inbound ", pressure=1.4)).first()
    assert (inbound.alos_used, inbound.spend_per_night_used, inbound.capacity_adjusted_multiplier) == (4.8, 728.5, pytest.approx(1.638))
    assert impact.impact(scenario(spark, -5.0)).first().direct_spend_million_rm == 0.0


@pytest.mark.parametrize("mode", ["domestic", "inbound", "blended"])
def test_splits_add_up(spark, mode):
    impacted = impact.impact(scenario(spark, mode=mode))
    direct = impacted.first().direct_spend_total_rm
    assert impact.category_split(impacted).agg(F.sum("amount_rm")).first()[0] == pytest.approx(direct, rel=2e-3)
    assert sum(impact.sector_split(impacted).select(*impact.SECTORS).first()) == pytest.approx(direct, rel=2e-3)


def test_multipliers_equal_matrix_inverse(spark):
    rng, n = np.random.default_rng(3), 7
    edges, sectors, expected = [], [], {}
    for year in (2019, 2020):
        z, x = rng.uniform(0, 1, (n, n)), rng.uniform(9, 14, n)
        gva, wages, cons = rng.uniform(1, 3, n), rng.uniform(0.5, 1.5, n), rng.uniform(0, 0.6, n)
        edges += [(year, i, j, float(z[i, j])) for i in range(n) for j in range(n)]
        sectors += [(year, j, float(x[j]), float(gva[j]), float(wages[j]), float(cons[j])) for j in range(n)]
        closed = np.zeros((n + 1, n + 1))
        closed[:n, :n], closed[:n, n], closed[n, :n] = z / x, cons / wages.sum(), wages / x
        one, two = np.linalg.inv(np.eye(n) - z / x), np.linalg.inv(np.eye(n + 1) - closed)[:n, :n]
        for j in range(n):
            expected[year, j] = (one[:, j].sum(), gva / x @ one[:, j], two[:, j].sum(), gva / x @ two[:, j])
    out = multipliers.multipliers(
        spark.createDataFrame(edges, "year int, i int, j int, z double"),
        spark.createDataFrame(sectors, "year int, j int, x double, gva double, wages double, consumption double"),
    ).collect()
    assert len(out) == 2 * n
    for r in out:
        assert [r[m] for m in multipliers.MEASURES] == pytest.approx(expected[r.year, r.j], rel=1e-7)


def test_composite_and_fallback_year(spark):
    weights = spark.createDataFrame(list(multipliers.SECTOR_WEIGHTS.items()), "j string, weight double")
    table = spark.createDataFrame([(2021, j, 2.0, 1.0, 3.0, 1.5) for j in multipliers.SECTOR_WEIGHTS], "year int, j string, type1_output double, type1_gva double, type2_output double, type2_gva double")
    total = multipliers.composite(table, weights)
    assert total.first().type1_output_multiplier == 2.0
    asked = spark.createDataFrame([(2030,)], "year int")
    assert multipliers.for_years(asked, total).first().used_year == 2021


def test_multipliers_say_when_they_do_not_converge(spark):
    edges = spark.createDataFrame([(2020, "a", "b", 9.0), (2020, "b", "a", 9.0)], "year int, i string, j string, z double")
    sectors = spark.createDataFrame([(2020, s, 10.0, 3.0, 2.0, 1.0) for s in "ab"], "year int, j string, x double, gva double, wages double, consumption double")
    exact = {r.j: r.type1_output for r in multipliers.multipliers(edges, sectors).collect()}
    assert exact == {"a": pytest.approx(10.0), "b": pytest.approx(10.0)}
    with pytest.raises(ValueError, match="converged"):
        multipliers.multipliers(edges, sectors, steps=3)


def test_multipliers_over_many_blocks_and_failing_years(spark):
    """Years of different sizes, one that diverges slowly, one fast, one with a missing number, one without trade."""
    rng, edges, sectors, expected = np.random.default_rng(5), [], [], {}
    for year, n, scale in ((2001, 9, 0.9), (2002, 4, 0.5), (2003, 5, 1.02), (2004, 5, 1e9), (2005, 3, 0.5), (2006, 2, 0.0)):
        a = rng.uniform(0, 1, (n, n)) * (rng.random((n, n)) < 0.6)
        a = a / max(np.abs(np.linalg.eigvals(a)).max(), 1e-3) * scale
        x = rng.uniform(9, 14, n)
        gva, wages, cons = rng.uniform(1, 3, n), rng.uniform(0.1, 0.4, n), rng.uniform(0, 0.1, n)
        edges += [(year, f"s{i}", f"s{j}", float(a[i, j] * x[j])) for i in range(n) for j in range(n) if a[i, j]]
        sectors += [(year, f"s{j}", float(x[j]), float(gva[j]), float(wages[j]), float(cons[j])) for j in range(n)]
        closed = np.zeros((n + 1, n + 1))
        closed[:n, :n], closed[:n, n], closed[n, :n] = a, cons / wages.sum(), wages / x
        one, two = np.linalg.inv(np.eye(n) - a), np.linalg.inv(np.eye(n + 1) - closed)[:n, :n]
        for j in range(n):
            expected[year, f"s{j}"] = (one[:, j].sum(), gva / x @ one[:, j], two[:, j].sum(), gva / x @ two[:, j])
    edges.append((2005, "s0", "s9", 1.0))
    sectors.append((2005, "s9", float("nan"), 1.0, 1.0, 1.0))
    trade = spark.createDataFrame(edges, "year int, i string, j string, z double")
    made = spark.createDataFrame(sectors, "year int, j string, x double, gva double, wages double, consumption double")
    rows, status = multipliers.all_multipliers(trade, made, edge=3)
    assert {r.year: r.converged for r in status.collect()} == {2001: True, 2002: True, 2003: False, 2004: False, 2005: False, 2006: True}
    got = {(r.year, r.j): [r[m] for m in multipliers.MEASURES] for r in rows.collect()}
    assert set(got) == {k for k in expected if k[0] in (2001, 2002, 2006)}
    for key, values in got.items():
        assert values == pytest.approx(expected[key], rel=1e-6)


def test_a_year_without_table_keeps_its_row(spark):
    table = spark.createDataFrame([(1999, 1.5)], "year int, type1_output_multiplier double")
    asked = spark.createDataFrame([(1999,), (1980,)], "year int")
    got = {r.requested_year: (r.type1_output_multiplier, r.used_year) for r in multipliers.for_years(asked, table).collect()}
    assert got == {1999: (1.5, 1999), 1980: (None, None)}
