"""Golden values of the column functions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from reliefgrid.functions import capacity, geo, numeric, similarity, text
from reliefgrid.plans.sqltext import ARCH_TYPES


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def lits(values):
    return F.array(*[F.lit(v) for v in values])


def test_rounding_and_defaults(spark):
    assert one(spark, numeric.rnd(F.lit(2.345), 2)) == 2.35
    assert one(spark, numeric.rnd(F.lit(float("nan")), 2)) is None and one(spark, numeric.rnd(F.lit(None).cast("double"))) is None
    assert one(spark, numeric.rnd(F.lit(1e18))) == 1e18 and one(spark, numeric.rnd(F.lit(-2.5))) == -2.0
    assert one(spark, numeric.or_default(F.lit(float("nan")), 7.0)) == 7.0
    assert one(spark, numeric.at_least(F.lit(None).cast("double"), 1.0)) == 1.0


@pytest.mark.parametrize(
    "token,value", [("1,234", 1234.0), ("56.1%", 56.1), ("(7.5)", -7.5), ("x1", None), ("", None), ("-3", -3.0), ("1e3", 1000.0)]
)
def test_parse_number(spark, token, value):
    assert one(spark, numeric.parse_number(F.lit(token))) == value


@pytest.mark.parametrize(
    "raw,tags",
    [
        ("A | b|a ", ["a", "b"]), ("x;y", ["x", "y"]), ("p, q", ["p", "q"]), ("one", ["one"]), ("['u', \"v\"]", ["u", "v"]),
        ("nan", []), ("[]", []), ("  ", []), (None, []),
    ],
)
def test_tag_set(spark, raw, tags):
    assert sorted(one(spark, similarity.tag_set(F.lit(raw).cast("string")))) == tags


def test_similarity_goldens(spark):
    assert one(spark, similarity.jaccard(lits("abc"), lits("bcde"))) == 0.4
    assert one(spark, similarity.jaccard(lits("abcd"), lits("cdef"))) == pytest.approx(1 / 3)
    a, b = [0.95, 0.20, 0.40, 0.95, 0.85], [0.90, 0.75, 0.10, 0.85, 0.60]
    assert one(spark, similarity.cosine(lits(a), lits(b))) == pytest.approx(0.9111, abs=1e-4)
    same = similarity.hybrid(F.lit(1.0), F.lit("a"), F.lit("b"), lits("a"), lits("b"))
    assert one(spark, same) == pytest.approx(0.60)
    untagged = similarity.hybrid(F.lit(0.8), F.lit(None), F.lit("b"), lits("a"), lits("b"))
    assert one(spark, untagged) == 0.8


def test_congestion_and_access(spark):
    for pressure, expected in [(0.8, 1.75), (1.0, 1.75), (1.4, 1.575), (99.0, 0.875)]:
        assert one(spark, capacity.congested_multiplier(F.lit(1.75), F.lit(pressure))) == pytest.approx(expected)
    assert one(spark, capacity.access_score(F.lit(60.0), F.lit(False))) == 63.8
    assert one(spark, capacity.access_score(F.lit(5.0), F.lit(True))) == 100.0
    assert one(spark, capacity.headroom_score(F.lit(50.0), F.lit(200.0))) == 25.0
    assert one(spark, capacity.headroom_score(F.lit(50.0), F.lit(0.0))) == 100.0


def test_distances(spark):
    assert one(spark, geo.haversine_km(F.lit(3.14), F.lit(101.69), F.lit(5.41), F.lit(100.33))) == pytest.approx(294, abs=3)
    assert one(spark, geo.radius_from_hectares(F.lit(71200.0))) == 15000
    ring = one(spark, geo.circle_ring(F.lit(4.0), F.lit(101.0), F.lit(1000.0)))
    assert len(ring) == 65 and ring[0] == ring[-1]
    back = geo.haversine_km(F.lit(4.0), F.lit(101.0), F.lit(ring[5].lat), F.lit(ring[5].lon))
    assert one(spark, back) == pytest.approx(6.0, abs=1e-6)


def test_stations_and_rail_path(spark):
    stop = one(spark, geo.nearest_station(F.lit(4.6), F.lit(101.08)))
    assert (stop.name, stop.line) == ("Ipoh", "ets")
    assert one(spark, geo.nearest_station(F.lit(6.35), F.lit(99.8))) is None
    ends = [F.lit(v) for v in (4.85, 100.73, 4.31, 101.15)]
    path = one(spark, geo.rail_path(*ends, geo.nearest_station(*ends[:2]), geo.nearest_station(*ends[2:])))
    assert [p.lat for p in path] == [4.85, 4.77, 4.6, 4.48, 4.31]
    ends = [F.lit(v) for v in (2.48, 102.2, 3.5, 102.35)]
    path = one(spark, geo.rail_path(*ends, geo.nearest_station(*ends[:2]), geo.nearest_station(*ends[2:])))
    assert [p.lat for p in path] == [2.48, 2.47, 2.58, 2.81, 3.23, 3.48, 3.48, 3.5]


def test_corridor_labels(spark):
    def way(km, mountain=False):
        none = F.lit(None).cast("struct<line:string>")
        return one(spark, geo.corridor(F.lit(km), F.lit(mountain), none, none))

    assert (way(10.0).distance_km, way(10.0).transit_mode) == (12.5, geo.MODE_LOCAL)
    assert way(130.0).transit_mode == geo.MODE_EXPRESSWAY
    assert way(33.0, True).distance_km == 57.8 and way(33.0, True).travel_time_mins == 99.0


def test_names(spark):
    assert one(spark, text.state_name(F.lit(" KL "))) == "W.P. Kuala Lumpur"
    assert one(spark, text.state_name(F.lit(None).cast("string"))) == ""
    assert one(spark, text.district_name(F.lit("Larut dan Matang"))) == "Larut & Matang"
    assert one(spark, text.state_key(F.lit("W.P. Labuan "))) == "labuan"
    assert one(spark, text.slug(F.lit("Sungai Pahang (Temerloh)"))) == "sungai_pahang"
    assert one(spark, text.zone_words(F.lit("Taman Negara (Jerantut)"), F.lit("Lipis Utara"))) == ["negara", "lipis", "utara"]
    assert one(spark, text.protection_class(F.lit("tahap2"))) == 2
    assert one(spark, text.protection_class(F.lit("1.0"))) == 1
    assert one(spark, text.protection_class(F.lit("Tahap 9"))) is None
    assert one(spark, text.zone_type_number(F.lit("ksas12"))) == 12
    assert one(spark, text.zone_type_number(F.lit("KSAS 16"))) is None


def test_rejoined_name(spark):
    broken = "A 1\nNEGERI\n 51.2 49.0\nSEMBILAN\nB 2"
    assert "NEGERI SEMBILAN 51.2 49.0" in one(spark, text.rejoin_split_name(F.lit(broken)))
    assert one(spark, text.rejoin_split_name(F.lit("Negeri\nSembilan 5"))) == "NEGERI SEMBILAN 5"


def test_income_retention(spark):
    expected = 0.35 + 0.03 * math.log1p(9.0 / 0.4)
    assert one(spark, capacity.income_retention(F.lit(9.0), F.lit(0.4))) == pytest.approx(expected)
    assert one(spark, capacity.income_retention(F.lit(1e9), F.lit(0.0))) == 0.65


@pytest.mark.parametrize("kinds", [3, 64, 150, 700])
def test_tag_bitmaps_count_as_tag_arrays(spark, kinds):
    """Also where two words are needed, and where tags share bits."""
    rng = random.Random(kinds)
    sets = [[], *([f"t{t}" for t in rng.sample(range(kinds), rng.randint(0, 3))] for _ in range(60)), [f"t{t}" for t in range(kinds)]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tags array<string>")
    known = similarity.known_tags(df, "tags")
    assert (known is None) == (kinds > similarity.TAG_BITS)
    df, words = similarity.tag_words(df, "tags", known, "w")
    assert len(words) == min(8, -(-kinds // 64))
    sides = [df.select(*[F.col(c).alias(p + c) for c in df.columns]) for p in "ab"]
    a, b = (
        similarity.TagBits([F.col(p + w) for w in words], F.size(p + "tags"), F.col(p + "tags") if known is None else None) for p in "ab"
    )
    cos, raw = F.lit(0.5), F.lit("x")
    pairs = sides[0].crossJoin(sides[1]).select(
        similarity.jaccard(a, b), similarity.jaccard(F.col("atags"), F.col("btags")),
        similarity.hybrid(cos, raw, raw, a, b), similarity.hybrid(cos, raw, raw, F.col("atags"), F.col("btags")),
    ).collect()
    assert len(pairs) == len(sets) ** 2 and any(0 < r[0] < 1 for r in pairs)
    assert all(r[0] == r[1] and r[2] == r[3] for r in pairs)


def test_hybrid_similarity_costs_a_pair_no_array_functions(spark, tmp_path):
    from reliefgrid.plans.similarity_plans import hybrid_similarity

    rng = random.Random(5)
    types = [t for _, t in ARCH_TYPES]
    keys = [0, 11400, 22800, 5, 11405]  # of two places; those of a place lie together
    parts = [(i, f"Brand#{i % 70}", rng.choice(types)) for i in range(300)]
    lines = [(k, rng.randrange(300), float(rng.randint(1, 50))) for k in keys for _ in range(40)]
    lines += [(11405, i, 500.0) for i in range(5)] + [(5, i, 500.0) for i in range(2, 7)]
    tables = {
        "supplier": ([(k, f"Supplier {k}", 1, 10.0) for k in keys], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(1, "N")], "n_nationkey int, n_name string"),
        "part": (parts, "p_partkey long, p_brand string, p_type string"),
        "lineitem": (lines, "l_suppkey long, l_partkey long, l_quantity double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = hybrid_similarity(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in ("zip_with", "aggregate(", "array_intersect") if f in plan]

    def place(k):
        own, brands = [(parts[p], q) for s, p, q in lines if s == k], {}
        for (_, brand, _), q in own:
            brands[brand] = brands.get(brand, 0) + q
        best = sorted(brands, key=lambda b: (-brands[b], b))[:5]
        total = sum(q for _, q in own)
        return [min(1.0, 2.5 * sum(q for (_, _, t), q in own if t == kind) / total) for kind in types], set(best)

    expected = {}
    for h in keys:
        for c in keys:
            if h != c and h % 11400 == c % 11400:
                (v, s), (w, t) = place(h), place(c)
                cos = sum(x * y for x, y in zip(v, w)) / math.sqrt(sum(x * x for x in v)) / math.sqrt(sum(y * y for y in w))
                expected[h, c] = (cos, len(s & t) / len(s | t), 0.6 * cos + 0.4 * len(s & t) / len(s | t))
    got = {(r.h_id, r.c_id): (r.cosine_similarity, r.jaccard_similarity, r.hybrid_similarity) for r in found.collect()}
    assert set(got) == set(expected) and got[5, 11405][1] == pytest.approx(3 / 7, abs=1e-6)
    for pair, values in expected.items():
        assert got[pair] == pytest.approx(values, abs=2e-6)
