"""Additive score attribution, intervention scenarios and dispatch accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.capacity import access_score, clip_null, distance_friction, headroom_score, proportion_score
from reliefgrid.functions.numeric import at_least, clip, or_default, rnd
from reliefgrid.functions.similarity import ARCHETYPE_LABELS
from reliefgrid.operators.match import FEASIBLE_KM, MIN_GAP, WEIGHTS

# Features of the score in display order, with their category.
FEATURES = [
    ("1. Archetype Affinity", "Positive Driver"),
    ("2. Transit Accessibility", "Positive Driver"),
    ("3. Spare Capacity", "Positive Driver"),
    ("4. B40 Community Benefit", "Positive Driver"),
    ("5. Ecological Risk Penalty", "Risk Guardrail"),
    ("6. Distance Friction", "Risk Guardrail"),
]


def _parts(weights: dict[str, float], spare: Column, access: Column) -> list[Column]:
    return [
        rnd(F.col("match_score") * weights["match"], 1),
        rnd(access * weights["accessibility"], 1),
        rnd(spare * weights["spare_capacity"], 1),
        rnd(F.col("community_benefit_score") * weights["community_benefit"], 1),
        -rnd(F.col("environmental_risk_penalty") * weights["environmental_risk"], 1),
        -rnd(distance_friction(F.col("distance_km")), 1),
    ]


def attribution(scored: DataFrame, weights: dict[str, float] | None = None, target: str = "final_wsm_score") -> DataFrame:
    """Add ``parts``: array(struct(ord, feature, category, points)) that sums exactly to the target score.

    The rounding residual goes to the largest positive part (the first on a tie). All of it is row-local.
    """
    points = _parts(weights or WEIGHTS, F.col("spare_capacity_blended"), F.col("accessibility_score"))
    with_points = scored.withColumn("_pts", F.array(*points))
    residual = rnd(F.col(target) - rnd(F.aggregate("_pts", F.lit(0.0), lambda a, p: a + p), 1), 1)
    positive = F.slice("_pts", 1, 4)
    with_points = with_points.withColumn("_res", residual).withColumn(
        "_main", F.array_position(positive, F.array_max(positive)).cast("int")
    )

    def part(i: int) -> Column:
        raw = F.get("_pts", F.lit(i))
        shifted = rnd(raw + F.col("_res"), 1)
        return F.struct(
            F.lit(i + 1).alias("ord"),
            F.lit(FEATURES[i][0]).alias("feature"),
            F.lit(FEATURES[i][1]).alias("category"),
            F.when(F.col("_main") == i + 1, shifted).otherwise(raw).alias("points"),
        )

    return with_points.withColumn("parts", F.array(*[part(i) for i in range(len(FEATURES))])).drop("_pts", "_res", "_main")


def attribution_long(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per hotspot, candidate and feature."""
    return attribution(scored, weights).select("h_id", "c_id", F.inline("parts"))


def dominant_parts(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Largest positive driver and deepest penalty of every pair, first feature on a tie."""
    parted = attribution(scored, weights)

    def ranked(category: str, sign: float) -> Column:
        chosen = F.filter("parts", lambda p: p["category"] == category)
        return F.array_min(
            F.transform(
                chosen,
                lambda p: F.struct(
                    (p["points"] * sign).alias("key"), p["ord"].alias("ord"), p["feature"].alias("feature"), p["points"].alias("points")
                ),
            )
        )

    driver, constraint = ranked("Positive Driver", -1.0), ranked("Risk Guardrail", 1.0)
    primary = F.when(
        rnd(F.col("spare_capacity_blended") * (weights or WEIGHTS)["spare_capacity"], 1)
        > rnd(F.col("community_benefit_score") * (weights or WEIGHTS)["community_benefit"], 1),
        "Spare Lodging Headroom",
    ).otherwise("B40 Grassroots Uplift")
    return parted.withColumns({"_d": driver, "_c": constraint}).select(
        "h_id", "c_id",
        F.col("_d.feature").alias("dominant_driver"), F.col("_d.points").alias("driver_points"),
        F.col("_c.feature").alias("dominant_constraint"), F.abs("_c.points").alias("constraint_penalty"),
        primary.alias("primary_driver"),
    )


def shared_pillars(h_vec: Column, c_vec: Column) -> Column:
    """Labels of archetypes at or above 0.5 on both sides; the strongest product when there are none."""
    labels = F.array(*[F.lit(t) for t in ARCHETYPE_LABELS])
    rows = F.arrays_zip(F.sequence(F.lit(0), F.lit(len(ARCHETYPE_LABELS) - 1)).alias("i"), h_vec.alias("h"), c_vec.alias("c"), labels.alias("label"))
    both = F.filter(rows, lambda x: (x["h"] >= 0.5) & (x["c"] >= 0.5))
    best = F.array_min(F.transform(rows, lambda x: F.struct((-(x["h"] * x["c"])).alias("k"), x["i"].alias("i"), x["label"].alias("label"))))
    return F.when(F.size(both) > 0, F.array_join(F.transform(both, lambda x: x["label"]), ", ")).otherwise(best["label"])


def explanation(scored: DataFrame) -> DataFrame:
    """Add the one-sentence explanation of a recommendation."""
    shared = F.array_sort(F.array_intersect("h_tags", "c_tags"))
    own = F.array_sort(F.col("c_tags"))

    def listed(tags: Column) -> Column:
        return F.array_join(F.transform(F.slice(tags, 1, 3), lambda t: F.initcap(F.replace(t, F.lit("_"), F.lit(" ")))), ", ")

    themes = (
        F.when(F.size(shared) > 0, F.concat(F.lit(" Features shared attraction themes ("), listed(shared), F.lit(").")))
        .when(F.size(own) > 0, F.concat(F.lit(" Features verified attractions including "), listed(own), F.lit(".")))
        .otherwise("")
    )
    way = F.format_string(
        "Situated %.0f km (~%.0f mins) via %s.", F.col("distance_km"), F.col("travel_time_mins"), F.col("transit_mode")
    )
    spare = F.when(
        F.col("c_capacity") > 0,
        F.format_string("+%,d pax/day buffer safely below ecological limit of %,.0f", F.col("c_headroom").cast("long"), F.col("c_eco")),
    ).otherwise("safe from bottleneck breach")
    sentence = F.concat(
        F.format_string("High compatibility (%.1f%% synergy across shared ", F.col("match_score")),
        shared_pillars(F.col("h_vec"), F.col("c_vec")), F.lit(")."), themes, F.lit(" "), way,
        F.format_string(" Operates with %.1f%% spare capacity headroom (", F.col("spare_capacity_score")), spare,
        F.format_string(
            "; blended spare-capacity pillar %.1f incl. absolute %.1f), targeting %.1f%% district B40 community uplift.",
            F.col("spare_capacity_blended"), F.col("absolute_headroom_score"), F.col("c_poverty"),
        ),
    )
    return scored.withColumn("shared_tags", F.array_join(shared, ", ")).withColumn("explanation", sentence)


def safe_absorption(
    df: DataFrame,
    capacity: str = "c_capacity",
    demand: str = "c_demand",
    eco: str = "c_eco",
    gap: str = "c_gap",
    rooms: str = "c_rooms",
    expansion: Column | None = None,
) -> DataFrame:
    """Headroom a place can take after a room-damped expansion, bound by capacity or ecology."""
    expansion = F.lit(0.0) if expansion is None else expansion
    factor = clip(or_default(rooms, 5000.0) / 5000.0, 0.4, 1.0)
    effective = F.greatest(F.lit(0.0), expansion) * factor
    old_gap = or_default(gap, 0.35)
    new_gap = clip(old_gap + effective / 100.0 * (1.0 - F.greatest(F.lit(0.0), old_gap)), 0.0, 1.0)
    eco_limit = or_default(eco, 0.0)
    with_room = df.withColumns(
        {"_factor": factor, "_effective": effective, "_gap": new_gap, "_room": new_gap * at_least(capacity, 0.0)}
    ).withColumn(
        "_eco_room", F.when(eco_limit > 0, F.greatest(F.lit(0.0), eco_limit - at_least(demand, 0.0))).otherwise(F.col("_room"))
    )
    return with_room.withColumns(
        {
            "original_gap": rnd(old_gap, 4),
            "simulated_gap": rnd("_gap", 4),
            "effective_capacity_pct": rnd("_effective", 2),
            "room_factor": rnd("_factor", 3),
            "sim_headroom_pax": rnd("_room", 1),
            "eco_headroom_pax": rnd("_eco_room", 1),
            "max_absorbable_pax": rnd(F.greatest(F.lit(0.0), F.least("_room", "_eco_room")), 1),
            "absorption_binding": F.when(F.col("_room") <= F.col("_eco_room"), "Sustainable capacity").otherwise("Ecological / KSAS cap"),
        }
    ).drop("_factor", "_effective", "_gap", "_room", "_eco_room")


def scenarios(df: DataFrame, rows: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """Repeat every row for each scenario (name, minutes cut, capacity %, compliance, diverted visitors)."""
    names = ["scenario", "time_cut", "capacity_pct", "compliance", "diverted"]
    literal = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return df.withColumn("_s", F.explode(F.array(*literal))).select(*df.columns, "_s.*")


def simulate(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Replay scored pairs under ``scenarios`` rows: score before and after, feasibility and diversion stress."""
    w = weights or WEIGHTS
    absorbed = safe_absorption(df, expansion=F.col("capacity_pct"))
    difficulty = (1.0 + F.greatest(F.lit(0.0), F.col("distance_km")) / 100.0) * F.when(F.col("rail_viable"), 1.0).otherwise(1.4)
    time_cut = F.greatest(F.lit(0.0), F.col("time_cut")) / difficulty
    new_time = F.greatest(F.lit(15.0), F.col("travel_time_mins") - time_cut)
    score_abs = headroom_score(F.col("c_headroom"), F.col("h_need"))

    def pillars(gap: Column, mins: Column) -> Column:
        spare = rnd(proportion_score(gap) * 0.5 + score_abs * 0.5, 1)
        total = sum(_parts(w, spare, access_score(mins, F.col("rail_viable"))), start=F.lit(0.0))
        return rnd(clip(total, 0.0, 100.0), 1)

    out = absorbed.withColumns(
        {
            "baseline_score": pillars(F.col("original_gap"), F.col("travel_time_mins")),
            "_raw": pillars(F.col("simulated_gap"), new_time),
            "time_difficulty": rnd(difficulty, 3),
            "effective_time_reduction_mins": rnd(time_cut, 2),
            "simulated_time_mins": new_time,
            "_after": F.col("sim_headroom_pax") - F.greatest(F.lit(0.0), F.col("diverted")),
            "base_eco_ok": F.when(F.col("c_eco") > 0, F.col("c_demand") < F.col("c_eco")).otherwise(F.lit(True)),
            "post_eco_ok": F.when(
                F.col("c_eco") > 0, F.col("c_demand") + F.greatest(F.lit(0.0), F.col("diverted")) < F.col("c_eco")
            ).otherwise(F.lit(True)),
        }
    ).withColumn("delta_score", rnd((F.col("_raw") - F.col("baseline_score")) * F.greatest(F.lit(0.0), F.col("compliance")), 2))
    overflow = (F.col("_after") < 0) | ~F.col("post_eco_ok")
    coverage = F.when(F.col("diverted") > 0, F.col("max_absorbable_pax") / F.when(F.col("diverted") > 0, F.col("diverted")) * 100.0)
    return out.withColumns(
        {
            "simulated_score": rnd(clip(F.col("baseline_score") + F.col("delta_score"), 0.0, 100.0), 1),
            "post_headroom_pax": rnd("_after", 1),
            "overflow": overflow,
            "diversion_verdict": F.when(overflow, "Overflow risk").otherwise("Absorbs diversion"),
            "is_feasible": (F.col("simulated_gap") > MIN_GAP) & (F.col("distance_km") <= FEASIBLE_KM) & F.col("base_eco_ok"),
            "absorption_coverage_pct": F.coalesce(rnd(coverage, 1), F.lit(100.0)),
            "policy_impact": F.when(F.col("delta_score") >= 5.0, "High Priority").otherwise("Incremental"),
        }
    ).drop("_raw", "_after")


def simulate_policy(pairs: DataFrame, time_cut: float = 0.0, capacity_pct: float = 0.0, diverted: float = 0.0) -> DataFrame:
    """One policy over all pairs at full compliance."""
    return simulate(scenarios(pairs, [("policy", time_cut, capacity_pct, 1.0, diverted)]))


def dispatch(df: DataFrame, safe: str = "max_absorbable_pax", excess: str = "h_need", bonus: Column | None = None) -> DataFrame:
    """Quota accounting: request within availability, dispatch within the safe limit, the rest left over."""
    factor = F.when(F.lit(True) if bonus is None else bonus, F.lit(1.15)).otherwise(F.lit(1.0))
    most = F.greatest(F.lit(500.0), F.floor(F.col(safe) / factor).cast("double"))
    need = F.col(excess)
    quota = F.greatest(F.lit(500.0), F.least(most, F.when(need > 0, need).otherwise(most)))
    return (
        df.withColumn("quota", F.floor(quota).cast("double"))
        .withColumn("effective_diverted", F.col("quota") * factor)
        .withColumn("dispatched", F.least("effective_diverted", safe))
        .withColumn("over_safe_pax", F.greatest(F.lit(0.0), F.col("effective_diverted") - F.col("dispatched")))
        .withColumn("relief_pct", F.coalesce(F.col("dispatched") / F.when(need > 0, need) * 100.0, F.lit(100.0)))
        .withColumn("unrelieved_pax", F.greatest(F.lit(0.0), need - F.col("dispatched")))
    )


def mitigated_curve(curve: DataFrame, diverted: str = "diverted", demand: str = "predicted_daily_demand") -> DataFrame:
    left = F.greatest(F.lit(0.0), F.col(demand) - F.col(diverted))
    return curve.withColumn("mitigated_daily_demand", left).withColumn(
        "mitigated_stress_pct", F.col("mitigated_daily_demand") / F.greatest(F.lit(1.0), F.col("sustainable_capacity")) * 100.0
    )


def vacancy_cushion(df: DataFrame, hotspot: str = "h_aor", relief: str = "c_aor") -> DataFrame:
    """Vacancy of the relief place minus that of the hotspot."""
    h_vac, c_vac = 100.0 - or_default(hotspot, 75.0), 100.0 - or_default(relief, 45.0)
    return df.withColumns({"hotspot_vacancy": h_vac, "relief_vacancy": c_vac, "vacancy_cushion": c_vac - h_vac})
