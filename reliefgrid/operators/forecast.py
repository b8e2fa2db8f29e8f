"""Month-by-month demand elasticity, training table, models, scoring and risk ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefgrid.functions.calendar import month_label, month_start, month_year_label
from reliefgrid.functions.geo import is_east_coast
from reliefgrid.functions.numeric import or_default, rnd
from reliefgrid.operators.normal import Fitted, logistic, ridge

# Month curves (January to December) of each archetype; beaches follow their coast.
BASIS_CURVES = {
    "arch_urban": [1.02, 0.92, 1.05, 0.94, 1.08, 1.18, 1.06, 1.12, 1.15, 1.08, 1.14, 1.28],
    "arch_food": [1.08, 1.42, 1.05, 1.38, 1.18, 1.32, 1.06, 1.35, 1.38, 1.05, 1.02, 1.52],
    "arch_heritage": [1.05, 1.48, 1.02, 1.42, 1.22, 1.35, 1.08, 1.32, 1.36, 1.02, 0.98, 1.55],
    "arch_nature": [1.10, 1.38, 1.08, 1.25, 1.28, 1.42, 1.12, 1.38, 1.40, 0.98, 0.92, 1.62],
    "arch_beach_west": [1.38, 1.45, 1.32, 1.18, 1.10, 1.22, 1.15, 1.24, 0.92, 0.90, 1.28, 1.58],
    "arch_beach_east": [0.55, 0.95, 1.15, 1.38, 1.45, 1.52, 1.42, 1.48, 1.32, 1.02, 0.48, 0.62],
}
# Archetype measure used when a place has none.
ARCHETYPE_DEFAULTS = {"arch_nature": 0.2, "arch_urban": 0.2, "arch_heritage": 0.2, "arch_food": 0.2, "arch_beach": 0.05}

# Place rules in order; the first name that matches decides (name words, [(months, factor), ...]).
PLACE_RULES = [
    (["gombak"], [([1], 1.35), ([2], 1.25)]),
    (["langkawi"], [([1, 2, 12], 1.16), ([9, 10], 0.86)]),
    (["kinta"], [([2], 1.18), ([12], 1.15)]),
    (["cameron"], [([2], 1.15), ([12], 1.22)]),
    (["melaka"], [([2], 1.18), ([7], 1.20)]),
    (["timur laut"], [([2], 1.22), ([7], 1.20)]),
    (["miri"], [([7, 8], 1.28), ([2], 1.18)]),
    (["limbang"], [([6], 1.38)]),
    (["johor bahru"], [([6, 9, 11, 12], 1.12)]),
    (["mersing"], [([7, 8], 1.22)]),
    (["samarahan"], [([11], 1.38), ([3, 10], 1.18)]),
    (["kampar"], [([3, 8], 1.20)]),
    (["kubang pasu", "muallim", "hulu langat"], [([10, 11], 1.15)]),
]
# State rules, applied on top (state, name word that must match or None, word that must not, months, factor, and what the
# heritage measure adds to it): the first is 1 + 0.30 (0.5 + 0.5 heritage).
STATE_RULES = [
    ("Sabah", None, None, [5], 1.15, 0.15),
    ("Sarawak", None, "samarahan", [6], 1.20, 0.0),
    ("Sarawak", "mukah", None, [4], 1.35, 0.0),
    ("Sarawak", "sri aman", None, [9, 10], 1.28, 0.0),
]
RULE_SCHEMA = "kind string, priority int, state string, word string, unless string, month_no int, factor double, per_heritage double"
NAME_ENDS = ("\u0002", "\u0003")  # stand before and after a name, so that a rule's word can ask for its beginning or its end
# Places whose forecast carries an ecological margin.
FRAGILE_WORDS = ["cameron", "langkawi", "ranau", "tioman"]

FEATURES = [
    "month_no", "quarter_no", "cuti_sekolah_days", "public_holidays", "long_weekends", "demand_multiplier",
    "base_demand", "base_capacity", "base_pressure", "scaled_demand", "min_inv", "min_exp", "near_count",
    "is_school_peak", "is_long_weekend", "month_sin", "month_cos", "aor_t1", "aor_ma3",
]
# Noise levels of the training table.
NOISE = (0.96, 1.0, 1.04)


def _curve(name: str, month_no: Column, curves: dict[str, list[float]]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in curves[name]]), month_no - 1)


def _any_word(name: Column, words: list[str]) -> Column:
    return F.lower(name).rlike("|".join(words))


def rule_table(spark: SparkSession, place_rules: list | None = None, state_rules: list | None = None) -> DataFrame:
    """The rules as rows, one for each word and month. Of the place rules the one of least priority whose word a name holds decides."""
    rows = []
    for priority, (words, seasons) in enumerate(PLACE_RULES if place_rules is None else place_rules):
        given = {month: factor for months, factor in reversed(seasons) for month in months}
        rows += [("place", priority, None, w, None, m, given.get(m, 1.0), 0.0) for w in words for m in range(1, 13)]
    for priority, (state, word, unless, months, factor, per_heritage) in enumerate(STATE_RULES if state_rules is None else state_rules):
        rows += [("state", priority, state, word, unless, m, factor, per_heritage) for m in months]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def held_words(names: DataFrame, words: DataFrame) -> DataFrame:
    """name, held: which of the words (column ``word``, lower case) each distinct name holds anywhere.

    Every piece of a name that is as long as some word is looked up among the words: an equi-join, whatever the number of words.
    """
    words = words.where("word IS NOT NULL").select("word").distinct()
    lengths = words.agg(F.collect_set(F.length("word"))).scalar()  # a few lengths
    marked = F.concat(F.lit(NAME_ENDS[0]), F.lower("name"), F.lit(NAME_ENDS[1]))
    spread = names.select("name").where("name IS NOT NULL").distinct().select("name", marked.alias("_marked"), F.explode(lengths).alias("_n"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("_marked") - F.col("_n") + 1, F.lit(1)))
    pieces = F.array_distinct(F.transform(starts, lambda at: F.substring(F.col("_marked"), at, F.col("_n"))))
    found = spread.select("name", F.explode(pieces).alias("word")).join(words, "word")
    return found.groupBy("name").agg(F.collect_set("word").alias("held"))  # words of one name


def with_rule_factors(df: DataFrame, rules: DataFrame, heritage: Column) -> DataFrame:
    """Add ``place_rule`` and ``state_rule`` to place x month rows (destination_name, state_name, month_no)."""
    held = held_words(df.select(F.col("destination_name").alias("name")), rules)
    by_place = rules.where("kind = 'place'")
    # the first rule of each name, then its factor in each month
    order = held.select("name", F.explode("held").alias("word")).join(by_place.select("word", "priority").distinct(), "word")
    first = order.groupBy("name").agg(F.min("priority").alias("priority"))
    factors = by_place.groupBy("priority", "month_no").agg(F.min("factor").alias("place_rule"))
    chosen = first.join(factors, "priority").select(F.col("name").alias("destination_name"), "month_no", "place_rule")
    # state rules of a month as one list, tested against the words of the name
    listed = rules.where("kind = 'state'").groupBy(F.col("state").alias("state_name"), "month_no").agg(
        F.collect_list(F.struct("word", "unless", "factor", "per_heritage")).alias("_rules")
    )
    out = df.join(chosen, ["destination_name", "month_no"], "left").join(listed, ["state_name", "month_no"], "left").join(
        held.select(F.col("name").alias("destination_name"), F.col("held").alias("_held")), "destination_name", "left"
    )
    holds = F.coalesce("_held", F.array().cast("array<string>"))
    applies = F.filter("_rules", lambda x: (x["word"].isNull() | F.array_contains(holds, x["word"])) & (
        x["unless"].isNull() | ~F.array_contains(holds, x["unless"])
    ))
    product = F.aggregate(applies, F.lit(1.0), lambda a, x: a * (x["factor"] + x["per_heritage"] * heritage))
    return out.withColumns(
        {"place_rule": F.coalesce("place_rule", F.lit(1.0)), "state_rule": F.coalesce(product, F.lit(1.0))}
    ).drop("_rules", "_held")


def elasticity(
    df: DataFrame,
    season_index: str = "season_index",
    rules: DataFrame | None = None,
    curves: dict[str, list[float]] | None = None,
    east_coast: Column | None = None,
) -> DataFrame:
    """Add ``demand_multiplier`` to place x month rows that hold archetypes, calendar days and the state index.

    ``rules`` is a table as of ``rule_table``, by default the fixed one.
    """
    curves = curves or BASIS_CURVES
    rules = rule_table(df.sparkSession) if rules is None else rules
    month = F.col("month_no")
    mix = {a: or_default(a, d) for a, d in ARCHETYPE_DEFAULTS.items()}
    total = F.greatest(F.lit(0.01), sum(mix.values(), start=F.lit(0.0)))
    east = is_east_coast("state_name", or_default("lon", 101.5)) if east_coast is None else east_coast
    beach = F.when(east, _curve("arch_beach_east", month, curves)).otherwise(_curve("arch_beach_west", month, curves))
    shape = mix["arch_beach"] / total * beach
    for name in ("arch_nature", "arch_urban", "arch_heritage", "arch_food"):
        shape = shape + mix[name] / total * _curve(name, month, curves)
    state_part = F.coalesce(F.col(season_index), F.lit(1.0)) * 0.18 + 0.82
    calendar_part = F.col("cuti_sekolah_days") / 15.0 * 0.10 + F.col("public_holidays") / 3.0 * 0.08 + 1.0
    ruled = with_rule_factors(df, rules, mix["arch_heritage"])
    factor = shape * state_part * calendar_part * F.col("place_rule") * F.col("state_rule")
    return ruled.withColumn("demand_multiplier", factor).select(*df.columns, "demand_multiplier")


def place_months(places: DataFrame, year: int) -> DataFrame:
    """Place x month rows of a year."""
    return places.withColumn("month_no", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn(
        "month", F.format_string("%d-%02d", F.lit(year), F.col("month_no"))
    )


def feature_table(df: DataFrame, demand: str = "daily_demand_peak", capacity: str = "sustainable_capacity") -> DataFrame:
    """The one feature builder for training and scoring; needs elasticity, proximity, encodings and lags."""
    base_demand, base_capacity = or_default(demand, 8000.0), or_default(capacity, 10000.0)
    return df.withColumns({"base_demand": base_demand, "base_capacity": base_capacity}).withColumns(
        {
            "quarter_no": F.floor((F.col("month_no") - 1) / 3) + 1,
            "base_pressure": F.col("base_demand") / F.greatest(F.lit(1.0), F.col("base_capacity")),
            "scaled_demand": F.col("base_demand") * F.col("demand_multiplier"),
        }
    )


def training_table(features: DataFrame, noise: tuple[float, ...] = NOISE) -> DataFrame:
    """Repeat each feature row per noise level with the demand it stands for and the spike label."""
    levels = F.explode(F.array(*[F.lit(n) for n in noise]))
    return features.withColumn("noise", levels).withColumns(
        {"actual_demand": F.col("scaled_demand") * F.col("noise")}
    ).withColumn("is_spike", F.when(F.col("actual_demand") >= F.col("base_capacity") * 1.05, 1.0).otherwise(0.0))


def condensed(features: DataFrame, noise: tuple[float, ...] = NOISE) -> DataFrame:
    """What the fits need of ``training_table`` without its repeated rows: the demand and the spikes of all noise levels together."""
    spikes = sum(
        (F.when(F.col("scaled_demand") * n >= F.col("base_capacity") * 1.05, 1.0).otherwise(0.0) for n in noise), start=F.lit(0.0)
    )
    demand = sum((F.col("scaled_demand") * n for n in noise), start=F.lit(0.0))
    return features.withColumns({"actual_demand": demand, "is_spike": spikes})


def _feature(name: str) -> Column:
    return F.col(name).cast("double")


def fit_volume(training: DataFrame, alpha: float = 0.5, levels: int = 1) -> Fitted:
    """Ridge on standardised features with a free intercept: ``alpha`` on the diagonal of the standardised normal matrix.

    A row of ``training`` is one observation, or with ``levels`` the sum of so many (``condensed``).
    """
    return ridge(training, FEATURES, "actual_demand", alpha, levels)


def fit_spike(training: DataFrame, alpha: float = 0.5, levels: int = 1, iterations: int = 30) -> Fitted:
    """Logistic fit with the same penalty on standardised features, which also keeps separable samples finite.

    One class alone gives its share.
    """
    return logistic(training, FEATURES, "is_spike", alpha, levels, iterations)


def chance(margin: Column) -> Column:
    return F.lit(1.0) / (F.exp(-margin) + 1.0)


def optimality(training: DataFrame, model: Fitted, label: str, predicted: Column, alpha: float = 0.5) -> DataFrame:
    """feature, gradient: slope of the penalised objective at the fitted point, over rows and the label's deviation; 0 at the optimum."""
    rest = F.col(label) - predicted
    row = training.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.avg(rest).alias("intercept"), F.stddev_pop(label).alias("spread"), *[
            F.struct(F.avg(_feature(f) * rest).alias("xr"), F.avg(_feature(f)).alias("m"), F.stddev_pop(_feature(f)).alias("s")).alias(f)
            for f in FEATURES
        ]).alias("t")
    )

    def slope(f: str) -> Column:
        x, s = F.col(f"t.{f}"), F.when(F.col(f"t.{f}.s") > 0, F.col(f"t.{f}.s")).otherwise(1.0)
        return ((x["xr"] - x["m"] * F.col("t.intercept")) / s - s * model.weights[f] * alpha / F.col("t.n")) / F.col("t.spread")

    entries = [F.struct(F.lit(f).alias("feature"), slope(f).alias("gradient")) for f in FEATURES]
    entries.append(F.struct(F.lit("intercept").alias("feature"), (F.col("t.intercept") / F.col("t.spread")).alias("gradient")))
    return row.select(F.inline(F.array(*entries)))


def model_scores(features: DataFrame, volume: Fitted, spike: Fitted) -> DataFrame:
    """Add the raw model outputs ``volume`` and ``spike_raw_prob``."""
    return features.withColumns({"volume": volume.margin(), "spike_raw_prob": chance(spike.margin())})


def risk_level(stress: Column) -> Column:
    return (
        F.when(stress >= 130, "🔴 CRITICAL SPIKE (>130% Cap)")
        .when(stress >= 100, "🟡 ELEVATED RUSH (100–130% Cap)")
        .otherwise("🟢 NORMAL FLOW (<100% Cap)")
    )


def lead_days(stress: Column) -> Column:
    return F.when(stress >= 130, 14).when(stress >= 100, 7).otherwise(3)


def calibrated(stress: Column, probability: Column) -> Column:
    return (
        F.when(stress >= 130, F.least(F.lit(0.99), F.greatest(probability, F.lit(0.94))))
        .when(stress >= 105, F.least(F.lit(0.95), F.greatest(probability, F.lit(0.78))))
        .when(stress < 90, F.least(probability, F.lit(0.20)))
        .otherwise(probability)
    )


def diversion_quota(excess: Column) -> Column:
    return F.when(excess > 0, rnd(excess * 0.65)).otherwise(F.lit(0.0))


def spike_risk(scored: DataFrame, fragile_words: list[str] | None = None) -> DataFrame:
    """Volume, stress, probability, class, lead time, excess and quota from raw model outputs."""
    fragile = _any_word(F.col("destination_name"), fragile_words or FRAGILE_WORDS)
    volume = F.col("volume") * F.when(fragile, F.lit(1.10)).otherwise(F.lit(1.0))
    stress = F.col("capacity_stress_pct")
    return (
        scored.withColumn("predicted_peak_volume", rnd(F.greatest(F.lit(500.0), volume)))
        .withColumn(
            "capacity_stress_pct", rnd(F.col("predicted_peak_volume") / F.greatest(F.lit(1.0), F.col("base_capacity")) * 100.0, 1)
        )
        .withColumns(
            {
                "spike_probability_pct": rnd(calibrated(stress, F.col("spike_raw_prob")) * 100.0, 1),
                "risk_level": risk_level(stress),
                "early_warning_lead_days": lead_days(stress),
                "excess_surge_volume": F.greatest(F.lit(0.0), F.col("predicted_peak_volume") - F.col("base_capacity")),
            }
        )
        .withColumn("recommended_diversion_quota", diversion_quota(F.col("excess_surge_volume")))
    )


def forward_curve(risk: DataFrame) -> DataFrame:
    """Twelve-month display curve of every place."""
    day = month_start("month")
    return risk.select(
        "destination_id", "month", month_label(day).alias("month_label"), month_year_label(day).alias("month_name"),
        F.col("predicted_peak_volume").alias("predicted_daily_demand"), F.col("base_capacity").alias("sustainable_capacity"),
        "capacity_stress_pct", "spike_probability_pct", "risk_level", "event_title",
    )


def rank_at_risk(risk: DataFrame, mitigation: DataFrame | None = None, top_n: int = 10, group: list[str] | None = None) -> DataFrame:
    """Top places by stress, then excess; ``mitigation`` (destination_name, diverted) lowers the load of named places.

    ``group`` (such as the month) ranks within each group; otherwise the table is ranked as a whole.
    """
    if mitigation is None:
        out = risk.withColumn("_div", F.lit(0.0))
    else:
        named = mitigation.groupBy(F.lower("destination_name").alias("_n")).agg(F.sum("diverted").alias("_div"))
        out = risk.withColumn("_n", F.lower("destination_name")).join(named, "_n", "left").drop("_n")
        out = out.withColumn("_div", F.coalesce("_div", F.lit(0.0)))
    active = F.col("_div") > 0
    net = F.when(active, F.greatest(F.lit(0.0), F.col("predicted_peak_volume") - F.col("_div"))).otherwise(F.col("predicted_peak_volume"))
    out = out.withColumns({"is_mitigated": active, "predicted_demand": net})
    stress = rnd(F.col("predicted_demand") / F.greatest(F.lit(1.0), F.col("base_capacity")) * 100.0, 1)
    out = out.withColumns(
        {
            "stress_pct": F.when(active, stress).otherwise(F.col("capacity_stress_pct")),
            "excess_surge": F.greatest(F.lit(0.0), F.col("predicted_demand") - F.col("base_capacity")),
        }
    )
    lowered = (
        F.when(F.col("stress_pct") < 100, F.least(F.col("spike_probability_pct"), F.lit(18.0)))
        .when(F.col("stress_pct") < 130, F.lit(55.0))
        .otherwise(F.col("spike_probability_pct"))
    )
    out = out.withColumns(
        {
            "spike_prob_pct": F.when(active, lowered).otherwise(F.col("spike_probability_pct")),
            "recommended_diversion": diversion_quota(F.col("excess_surge")),
            "risk_level": risk_level(F.col("stress_pct")),
        }
    ).drop("_div")
    best = [F.desc("stress_pct"), F.desc("excess_surge"), F.asc("destination_id")]
    if not group:
        return out.orderBy(*best).limit(top_n)
    order = Window.partitionBy(*group).orderBy(*best)
    return out.withColumn("risk_rank", F.row_number().over(order)).where(F.col("risk_rank") <= top_n)
