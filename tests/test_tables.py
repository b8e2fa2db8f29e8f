"""Golden tables: capacity, baseline, occupancy, master, market, reports, surveys, quality."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reliefgrid import schemas
from reliefgrid.operators import baseline, capacity, lookup, market, master, quality, ranking, reports, rollup, survey, zones
from reliefgrid.operators.impact import INBOUND_SHARES
from reliefgrid.operators.interest import peak_months

# name, demand, six capacities, expected pressure and capacity
PILOT = [
    ("George Town", 22500, 25500, 19000, 21000, 22000, 25000, 18500, 1.216, 18500),
    ("Taiping", 2900, 5800, 7500, 6200, 8000, 5400, 7000, 0.537, 5400),
    ("Tanah Rata", 14000, 16000, 11500, 12000, 13000, 10000, 11000, 1.4, 10000),
    ("Kuala Lipis", 1850, 3600, 6500, 4500, 6000, 5000, 5500, 0.514, 3600),
    ("Bandar Hilir", 24000, 21500, 18500, 19000, 17500, 22000, 18000, 1.371, 17500),
    ("Muar", 4600, 11500, 14000, 10500, 18000, 25000, 12000, 0.438, 10500),
    ("Kuah", 18500, 19000, 15000, 16000, 13500, 14000, 15000, 1.37, 13500),
    ("Yan", 2100, 4800, 7000, 5500, 6500, 6000, 6200, 0.438, 4800),
]
CAPS = "cc_accommodation double, cc_transport double, cc_attraction double, cc_water_waste double, cc_ecology double, cc_social double"


def test_diagnosis_goldens(spark):
    df = spark.createDataFrame([tuple(map(lambda v: v if isinstance(v, str) else float(v), r)) for r in PILOT],
                               f"name string, daily_demand_peak double, {CAPS}, pressure double, capacity double")
    bad = capacity.diagnose(df).where("continuous_pressure <> pressure OR sustainable_capacity <> capacity")
    assert bad.count() == 0


def test_diagnosis_edges(spark):
    nan = float("nan")
    df = spark.createDataFrame([(50000.0, 60000.0, 70000.0, 80000.0, 25000.0, 90000.0, 65000.0), (10.0, nan, 0.0, 5.0, 5.0, 5.0, 5.0)],
                               f"daily_demand_peak double, {CAPS}")
    first, second = capacity.diagnose(df).orderBy(F.desc("daily_demand_peak")).collect()
    assert (first.sustainable_capacity, first.excess_demand, first.pressure_percent, first.capacity_gap_percent) == (25000, 25000, 200, -100)
    assert first.binding_constraint == "Municipal Water & Waste Buffer" and first.is_overcapacity
    assert (second.sustainable_capacity, second.binding_constraint) == (1.0, "Accommodation Supply")


def test_rank_scores_share_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 5.0)], "id int, v double")
    out = {r.id: r.s for r in ranking.rank_scores(df, {"s": ("v", True)}).collect()}
    assert out == {1: 0.0, 2: 50.0, 3: 50.0, 4: 100.0}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_rank_scores_on_many_ranges(spark, monkeypatch, broadcast):
    """A third of the values equal, a tenth missing; ranks by range, and joined back both ways."""
    monkeypatch.setattr(ranking, "RANGE_VALUES", 40)
    monkeypatch.setattr(ranking, "BROADCAST_VALUES", broadcast)
    v = F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 10 == 1, None).otherwise((F.col("id") % 700).cast("double"))
    df = spark.range(2000).select("id", v.alias("v"), (F.col("id") % 7).cast("double").alias("w"))
    out = ranking.rank_scores(df, {"up": ("v", True), "down": ("v", False), "w_up": ("w", True)}).toPandas().sort_values("id")
    assert len(out) == 2000 and out["up"].isna().sum() == out["v"].isna().sum() > 100
    expected = (out["v"].rank() - 1) / (len(out) - 1) * 100
    assert (out["up"] - expected).abs().max() < 1e-9 and (out["up"] + out["down"] - 100).abs().max() < 1e-9
    assert (out["w_up"] - (out["w"].rank() - 1) / (len(out) - 1) * 100).abs().max() < 1e-9


def test_next_event_breaks_ties(spark):
    rows = [("a", 5, 2), ("a", 5, 1), ("a", 3, 9), ("b", 1, 1), ("b", 1, 7)]
    got = ranking.next_or_last(spark.createDataFrame(rows, "k string, ts int, id int"), "k", "ts", F.lit(4)).collect()
    assert {(r.k, r.ts, r.id) for r in got} == {("a", 5, 1), ("b", 1, 7)}


def test_allocation_keeps_rows_without_total(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 1.0)], "k string, w double")
    totals = spark.createDataFrame([("x", 4000.0)], "k string, total double")
    got = rollup.allocate(df, totals, "k", F.col("w"), "total").collect()
    assert sorted((r.k, r.allocated or 0.0) for r in got) == [("x", 1000.0), ("x", 3000.0), ("y", 0.0)]


def test_state_baseline_golden(spark):
    # four states of the published table with the ratios that follow from their inputs
    rows = [("Sabah", 20592.0, 16080.0, 6081.5, 3742.0, 4890.0, 17.7, 26706.0), ("Sarawak", 19626.0, 17901.0, 5701.0, 2517.5, 5504.0, 8.4, 26592.0),
            ("Kedah", 14651.0, 13444.0, 6854.4, 2217.1, 4895.0, 8.4, 19029.0)]
    df = spark.createDataFrame(rows, "state string, domestic_visitors_2024_000 double, domestic_visitors_2023_000 double, overnight_tourists_2024_000 double, "
                               "population_2024_000 double, median_household_income_2024_rm double, poverty_rate_2024_pct double, hotel_rooms_2023 double")
    out = {r.state: r for r in baseline.baseline_scores(df).collect()}
    assert out["Sabah"].visitor_growth_2024_pct == pytest.approx(28.059701492537314)
    assert out["Sarawak"].annual_visitors_per_resident == pytest.approx(7.795829195630586)
    assert out["Kedah"].annual_overnight_tourists_per_room == pytest.approx(360.2081034210941)
    assert out["Sabah"].community_opportunity_proxy_score == pytest.approx(100.0)


def test_one_to_one_merge_rejects_repeats(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2)], "state string, v int")
    b = spark.createDataFrame([("x", 3)], "state string, w int")
    with pytest.raises(PySparkException):
        lookup.join_one_to_one(a, b, "state").collect()
    assert [tuple(r) for r in lookup.merge_violations(a, b, "state").collect()] == [("x", 2, "left")]


def test_required_lookup(spark):
    ref = spark.createDataFrame([("Perak", "Kinta", "MBI")], "state_name string, district_name string, pbt_name string")
    ok = spark.createDataFrame([("Perak", "Kinta")], "state_name string, district_name string")
    assert lookup.require_match(ok, ref, ["state_name", "district_name"], "pbt_name").first().pbt_name == "MBI"
    bad = spark.createDataFrame([("Perak", "Nowhere")], "state_name string, district_name string")
    with pytest.raises(PySparkException):
        lookup.require_match(bad, ref, ["state_name", "district_name"], "pbt_name").collect()


def test_rollup_preserves_sums(spark):
    rows = [(i, f"S{i % 3}", f"D{i}", float(i), 100.0 + i, 10.0 * i, 90.0, 5.0 * i, 50.0, 1.0, 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "destination_id long, state_name string, destination_name string, lat double, lon double, daily_demand_peak double, "
                               "sustainable_capacity double, total_rooms double, latest_aor_pct double, continuous_pressure double, poverty_rate double")
    out = rollup.state_rollup(df, with_total=True).collect()
    total = next(r for r in out if r.state_name is None)
    assert total.daily_demand_peak == sum(r[5] for r in rows) and total.district_count == 20
    assert sum(r.total_rooms for r in out if r.state_name) == total.total_rooms
    assert next(r for r in out if r.state_name == "S1").rep_district == "D19"


CALENDAR = [1.15, 1.35, 1.20, 1.40, 1.30, 1.38, 1.05, 1.42, 1.45, 1.02, 0.98, 1.60, 1.25, 1.50, 1.18, 1.42, 1.32, 1.40, 1.05, 1.45, 1.48, 1.00, 0.96, 1.65]


def test_peak_months(spark):
    df = spark.createDataFrame([(f"{2025 + i // 12}-{i % 12 + 1:02d}", v) for i, v in enumerate(CALENDAR)], "month string, demand_multiplier double")
    assert tuple(peak_months(df).first()) == ("December", "September")


def test_market_matrix(spark):
    def row(market, metric, audience, category, value, numeric, display=None, order=1):
        total = metric == "Total expenditure"
        return (2024, market, audience, metric, "Full year" if total else "Part", None if total else "Jan-Dec", category, numeric, display, value, order)

    share = "Expenditure components share"
    raw = spark.createDataFrame([
        row("Overall", "Total expenditure", "Visitors", None, 1000.0, None), row("A", "Total expenditure", "Visitors", None, 300.0, None),
        row("A", "Total expenditure", "Visitors", None, 400.0, None, order=2), row("B", "Total expenditure", "Tourists", None, 900.0, None),
        row("A", share, "Tourists", "Shopping", None, 60.0), row("A", share, "Tourists", "Fuel", None, None, "40.0%"), row("C", share, "Tourists", "Fuel", None, 5.0),
    ], "year int, market string, audience string, metric_group string, period_type string, selected_period string, spending_category string, value_numeric double, "
       "value_display string, value_rm_million double, row_id int")
    out = market.market_matrix(raw)
    got = {(r.market, r.spending_category): (r.value_rm_million, r.percentage_share) for r in out.where("market <> 'A' OR spending_category <> 'All spending categories'").collect()}
    assert got == {("Overall", market.ALL_CATEGORIES): (1000.0, 100.0), ("A", "Shopping"): (240.0, 60.0), ("A", "Fuel"): (160.0, 40.0), ("C", "Fuel"): (0.0, 5.0)}
    asked = spark.createDataFrame([("a",), ("Nowhere",)], "requested string")
    assert market.market_breakdown(out, asked).where("requested = 'a'").count() == 2


def test_market_fallbacks(spark):
    columns = "year int, metric_group string, market string, period_type string, audience string, value_rm_million double"
    total = "Total expenditure"
    raw = spark.createDataFrame([(2024, total, "A", "Full year", "Visitors", 5.0), (2024, total, "A", "Part", "Visitors", 9.0), (2024, total, "B", "Part", "Visitors", 7.0),
                                 (2023, total, "B", "Part", "Tourists", 7.0), (2023, total, "Overall", "Full year", "Visitors", 99.0)], columns)
    assert [tuple(r) for r in market.top_markets_raw(raw, 2024).collect()] == [("A", 5.0)]
    assert [tuple(r) for r in market.top_markets_raw(raw, 2023).collect()] == [("B", 7.0)]
    none = spark.createDataFrame([], "spending_category string, percentage_share double, value_rm_million double")
    rows = {r.spending_category: r.value_rm_million for r in market.or_reference(none, INBOUND_SHARES, 106780.0).collect()}
    assert len(rows) == 12 and rows["Shopping"] == pytest.approx(0.3736 * 106780.0, abs=1e-3)
    one = spark.createDataFrame([("Fuel", 100.0, 1.0)], none.schema)
    assert market.or_reference(one, INBOUND_SHARES, 106780.0).count() == 1


def test_reports(spark):
    texts = spark.createDataFrame([
        ("AOR_2019.pdf", "head\nPENANG 61.2 63.4 2.2\nNEGERI\n 40.1 44.0 3.9\nSEMBILAN\nPulau Pinang 1 2 3"),
        ("AOR_Q2_2024.pdf", "Johor x 50.1 51.26"), ("AOR_2022.pdf", "Kedah 45.5 40.0 5.5"), ("AOR_bad.pdf", "Kedah 1 2"),
    ], "file_name string, text string")
    got = {(r.year, r.period, r.state): r.average_occupancy_rate_pct for r in reports.occupancy_rates(texts).collect()}
    assert got == {(2019, "Annual", "Pulau Pinang"): 63.4, (2019, "Annual", "Negeri Sembilan"): 44.0, (2024, "Q2", "Johor"): 51.3, (2022, "Annual", "Kedah"): 45.5}
    assert [r.file_name for r in reports.failed_files(texts).collect()] == ["AOR_bad.pdf"]
    rooms = spark.createDataFrame([("hotel_inventory_2023_Q1.pdf", "1 Johor 535 34,294\nKedah 5682")], "file_name string, text string")
    assert {(r.state, r.hotels_count, r.rooms_count) for r in reports.hotel_inventory(rooms).collect()} == {("Johor", 535, 34294), ("Kedah", None, 5682)}
    guests = spark.createDataFrame([("hotel_guests_2020.pdf", "Johor 12 2,000 3,000\nPerak 1,500 2,500 9,999")], "file_name string, text string")
    rows = reports.hotel_guests(guests)
    assert {(r.state, r.total_guests) for r in rows.collect()} == {("Johor", 5000), ("Perak", 9999)}
    assert [r.state for r in quality.guest_total_violations(rows).collect()] == ["Perak"]
    arrivals = spark.createDataFrame([("visitor_feb_2023.pdf", "SINGAPORE 100 8,308\nChina 900")], "file_name string, text string")
    assert {(r.month, r.arrival_type, r.origin_market, r.arrivals_count) for r in reports.arrivals(arrivals).collect()} == {
        ("FEB", "visitor", "Singapore", 8308), ("FEB", "visitor", "China", 900)}


def test_survey_sheets(spark):
    cells = spark.createDataFrame([
        (2024, "8B", 0, 1, "Negeri"), (2024, "8B", 0, 2, "Daerah"), (2024, "8B", 1, 1, "Negeri Sembilan"), (2024, "8B", 1, 2, "1. Seremban\n2) Port Dickson\n3. x"),
        (2024, "8B", 1, 6, "Sabah"), (2024, "8B", 1, 7, "1. Kota Kinabalu"), (2024, "6", 3, 0, "Membeli-belah\n(Shopping)"), (2024, "6", 3, 1, "1,200.5"),
        (2024, "6", 3, 2, "abc"), (2024, "6", 3, 3, "37.4"), (2024, "6", 4, 0, "Lain"), (2024, "6", 4, 1, "5"),
    ], schemas.CELLS)
    ranked = {(r.state, r["rank"], r.district_name) for r in survey.ranked_lists(cells, "8B", "district_name").collect()}
    assert ranked == {("Negeri Sembilan", 1, "Seremban"), ("Negeri Sembilan", 2, "Port Dickson"), ("Sabah", 1, "Kota Kinabalu")}
    assert [(r.component, r.value_1, r.value_2) for r in survey.spending_components(cells).collect()] == [("Membeli-belah", 1200.5, 37.4)]


def test_search_ranks(spark):
    raw = spark.createDataFrame([("2023", "January", "SELANGOR", "JOHOR", None), ("2023", "August", "0", "0", "0")], "Year string, Month string, `Rank 1` string, `Rank 2` string, `Rank 3` string")
    assert {(r["rank"], r.state) for r in survey.search_ranks(raw, 3).collect()} == {(1, "SELANGOR"), (2, "JOHOR")}


ZONE = dict(ksas_code="KSAS 2", jenis_ksas="Kawasan Bukit, Tanah Tinggi dan Kawasan Cerun", tahap="Tahap 1", nama="Hill", luas_h=71200.0, akt_1="a", akt_syarat="b",
            akt_0="c", negeri="Pahang", daerah="Cameron Highlands", bp="NA", bpk="NA", tahun_data=2025, lat=4.47, lon=101.38, radius_m=15000, area_derived=True,
            radius_basis="x", sumber="s", representation="r", keyakinan="tinggi", label_peta="l", key="k1")


def test_zone_rules(spark):
    def zones_of(*rows):
        return spark.createDataFrame([tuple({**ZONE, **r}.values()) for r in rows], schemas.ZONES)

    assert quality.zone_violations(zones_of({})).count() == 0
    faults = {"protection class": dict(tahap="Tahap 7"), "type code": dict(ksas_code="KSAS 44"), "class legal for type": dict(ksas_code="KSAS 3", jenis_ksas="Kawasan Simpanan Mineral"),
              "latitude": dict(lat=9.0), "longitude": dict(lon=90.0), "radius step": dict(radius_m=15100), "radius fits area": dict(radius_m=20000),
              "area known": dict(luas_h=None, area_derived=False), "year": dict(tahun_data=1990), "type name": dict(jenis_ksas="Something")}
    for rule, change in faults.items():
        assert rule in {r.rule for r in quality.zone_violations(zones_of(change)).collect()}, rule
    assert {r.rule for r in quality.zone_violations(zones_of({}, {})).collect()} == {"unique key"}
    with pytest.raises(ValueError):
        quality.zone_violations(zones_of({}).drop("sumber"))
    assert quality.require_clean(zones_of({}), quality.zone_violations(zones_of({}))).count() == 1
    with pytest.raises(PySparkException):
        bad = zones_of(dict(lat=9.0))
        quality.require_clean(bad, quality.zone_violations(bad)).collect()
    assert quality.uncovered_types(zones_of({})).count() == 14


def test_zone_views(spark):
    zone = spark.createDataFrame([tuple(ZONE.values()), tuple({**ZONE, "key": "k2", "lat": 1.0, "lon": 110.0, "nama": "Bako Reserve", "daerah": "Kuching"}.values())], schemas.ZONES)
    places = spark.createDataFrame([(1, "Cameron Highlands", 4.47, 101.38, 1.33), (2, "Batang Padang", 4.4, 101.3, 0.60), (3, "Bako", 5.0, 115.0, 0.5), (4, "Reserve Town", 6.0, 116.0, 0.2)],
                                   "destination_id long, destination_name string, lat double, lon double, continuous_pressure double")
    watched = zones.watch_list(places, zone)
    assert [(r.key, r.watch_districts) for r in watched.collect()] == [("k1", ["Cameron Highlands"])]
    assert zones.watch_list(places.where("destination_id = 2"), zone).count() == 0
    alerts = zones.hotspot_alerts(places, zone)
    assert {r.destination_id: r.key for r in alerts.collect()} == {1: "k1", 2: "k1", 4: "k2"}
    shown = {(r.destination_id, r.key, r.is_alert) for r in zones.display_zones(places, zone, alerts, watched).collect()}
    assert shown == {(None, "k1", True), (4, "k2", True)}
    assert zones.zone_records(zone).first().gazetted_area_km2 == 712.0


def test_master(spark):
    districts = spark.createDataFrame([("Kinta", "Perak", 4.6, 101.1), ("Gerik", "Perak", 5.4, 101.1), ("W.P. Labuan", "W.P. Labuan", 5.3, 115.2)],
                                      "district_name string, state_name string, lat double, lon double")
    profiles = spark.createDataFrame([("Perak", "Kinta", 0.9, 0.5, None, 0.9, 0.8, "food | caves")], "state_name string, district_name string, arch_heritage double, arch_nature double, "
                                     "arch_beach double, arch_food double, arch_urban double, poi_tags string")
    money = spark.createDataFrame([("Perak", 5.0, 6000.0, 5000.0)], "state string, poverty double, income_mean double, income_median double")
    rates = spark.createDataFrame([("a", 2024, "Annual", "Perak", 50.0), ("a", 2025, "Annual", "Perak", 54.0), ("a", 2020, "Annual", "Perak", 1.0)], schemas.OCCUPANCY)
    rooms = spark.createDataFrame([("a", 2024, "Annual", "Perak", None, 10000), ("a", 2024, "Annual", "Labuan", None, 2000)], schemas.INVENTORY)
    out = {r.district_name: r for r in master.build_master(districts, profiles, money, rates, rooms).collect()}
    assert out["Kinta"].total_rooms + out["Gerik"].total_rooms == pytest.approx(10000, abs=1)
    assert out["W.P. Labuan"].total_rooms == 2000 and out["W.P. Labuan"].poverty_rate == 4.5 and out["W.P. Labuan"].latest_aor_pct == 52.0
    assert out["Kinta"].latest_aor_pct == 52.0 and out["Gerik"].poi_tags == master.DEFAULT_TAGS
    assert out["Gerik"].continuous_pressure == pytest.approx(out["Gerik"].daily_demand_peak / out["Gerik"].sustainable_capacity, abs=2e-3)
    loose = {r.district_name: r for r in master.build_master(districts, profiles, money, rates, rooms, strict_names=False).collect()}
    assert loose["W.P. Labuan"].total_rooms == 15000
