"""Relief matching: the best alternatives for every hotspot in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.capacity import (
    access_score,
    clip_null,
    community_score,
    distance_friction,
    ecological_risk,
    excess_pax,
    headroom_pax,
    proportion_score,
)
from reliefgrid.functions.geo import MOUNTAIN_PATTERN, corridor, haversine_km, is_mountain, nearest_station
from reliefgrid.functions.numeric import clip, or_default, rnd
from reliefgrid.functions.similarity import ARCHETYPES, archetype_vector, cosine_with_norms, dot, hybrid, tag_set
from reliefgrid.operators import bounds
from reliefgrid.operators.nearby import GROUP_ROWS, has_at_most, radius_join
from reliefgrid.session import cut_lineage

# Pillar weights, similarity blend, gates and radii (km by road).
WEIGHTS = {
    "match": 0.30,
    "accessibility": 0.20,
    "spare_capacity": 0.25,
    "community_benefit": 0.20,
    "environmental_risk": 0.05,
}
ALPHA = 0.60
MIN_GAP = 0.10
REGIONAL_KM = 180.0
FEASIBLE_KM = 350.0
# The lowest road factor is 1.25 and factors never fall below it, so road limits give these straight-line reaches.
ROAD_FACTOR_MIN = 1.25
SEED_LEAVES = 5  # leaves beyond ``top_n`` that give a hotspot its first floor
LEAST_SCORE = 0.05  # scores are tenths, so a bound below this means 0

# Shortlist classes of a pair: feasible and regional, feasible, regional only, neither.
FEASIBLE_REGIONAL, FEASIBLE_FAR, REGIONAL_ONLY, OTHER = 1, 2, 3, 4


def prepare_places(
    places: DataFrame,
    tags: str = "poi_tags",
    archetypes: list[str] | None = None,
    mountain_pattern: str = MOUNTAIN_PATTERN,
) -> DataFrame:
    """Per-place inputs of the pair score, worked out once per place and not once per pair."""
    vector = archetype_vector(archetypes or ARCHETYPES)
    return places.select(
        F.col("destination_id").alias("id"),
        F.col("destination_name").alias("name"),
        or_default("lat", 0.0).alias("lat"),
        or_default("lon", 0.0).alias("lon"),
        or_default("capacity_gap", 0.50).alias("gap"),
        or_default("sustainable_capacity", 0.0).alias("capacity"),
        or_default("daily_demand_peak", 2000.0).alias("demand"),
        headroom_pax("sustainable_capacity", "daily_demand_peak").alias("headroom"),
        excess_pax("sustainable_capacity", "daily_demand_peak").alias("need"),
        or_default("poverty_rate", 5.0).alias("poverty"),
        or_default("cc_ecology", 5000.0).alias("eco"),
        or_default("total_rooms", 5000.0).alias("rooms"),
        vector.alias("vec"),
        F.sqrt(dot(vector, vector)).alias("norm"),
        F.col(tags).alias("raw_tags"),
        tag_set(tags).alias("tags"),
        is_mountain("destination_name", mountain_pattern).alias("mountain"),
        nearest_station(or_default("lat", 0.0), or_default("lon", 0.0)).alias("station"),
    )


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def same_place() -> Column:
    """A candidate that is the hotspot itself, by id or by name."""
    h_name, c_name = F.lower(F.trim(F.col("h_name"))), F.lower(F.trim(F.col("c_name")))
    by_id = F.trim(F.col("h_id").cast("string")) == F.trim(F.col("c_id").cast("string"))
    by_name = (h_name != "") & (h_name == c_name)
    return F.coalesce(by_id, F.lit(False)) | F.coalesce(by_name, F.lit(False))


def score_steps(weights: dict[str, float] | None = None, alpha: float = ALPHA) -> list[dict[str, Column]]:
    """Score columns in dependency order; each step reads the columns of the steps before it."""
    w = weights or WEIGHTS
    mountain = F.col("h_mountain") | F.col("c_mountain")
    cos = cosine_with_norms(F.col("h_vec"), F.col("c_vec"), F.col("h_norm"), F.col("c_norm"))
    similar = hybrid(cos, F.col("h_raw_tags"), F.col("c_raw_tags"), F.col("h_tags"), F.col("c_tags"), alpha)
    absolute = F.coalesce(
        clip_null(rnd(F.col("c_headroom") / F.when(F.col("h_need") > 0, F.col("h_need")) * 100.0, 1)),
        F.when(F.col("c_headroom") > 0, F.lit(100.0)).otherwise(F.col("spare_capacity_score")),
    )
    weighted = (
        F.col("match_score") * w["match"]
        + F.col("accessibility_score") * w["accessibility"]
        + F.col("spare_capacity_blended") * w["spare_capacity"]
        + F.col("community_benefit_score") * w["community_benefit"]
        - F.col("environmental_risk_penalty") * w["environmental_risk"]
    )
    base, friction = rnd(clip(weighted, 0.0, 100.0), 1), distance_friction(F.col("distance_km"))
    feasible = (F.col("c_gap") > MIN_GAP) & (F.col("c_demand") < F.col("c_eco")) & (F.col("distance_km") <= FEASIBLE_KM)
    regional = F.col("distance_km") <= REGIONAL_KM
    return [
        {
            "_way": corridor(F.col("straight_km"), mountain, F.col("h_station"), F.col("c_station")),
            "match_score": rnd(similar * 100.0, 1),
            "spare_capacity_score": proportion_score(F.col("c_gap")),
            "community_benefit_score": community_score(F.col("c_poverty")),
            "environmental_risk_penalty": ecological_risk(F.col("c_eco"), F.col("c_demand")),
        },
        {
            **{c: F.col(f"_way.{c}") for c in ("distance_km", "travel_time_mins", "transit_mode", "rail_viable")},
            "accessibility_score": access_score(F.col("_way.travel_time_mins"), F.col("_way.rail_viable")),
            "absolute_headroom_score": absolute,
        },
        {
            "spare_capacity_blended": rnd(F.col("spare_capacity_score") * 0.5 + F.col("absolute_headroom_score") * 0.5, 1),
            "is_feasible": feasible,
            "distance_friction_penalty": rnd(friction, 1),
        },
        {
            "final_wsm_score": rnd(F.greatest(F.lit(0.0), base - friction), 1),
            "_class": F.when(F.col("is_feasible") & regional, FEASIBLE_REGIONAL)
            .when(F.col("is_feasible"), FEASIBLE_FAR)
            .when(regional, REGIONAL_ONLY)
            .otherwise(OTHER),
        },
    ]


def _scored(pairs: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    for step in steps:
        pairs = pairs.withColumns(step)
    return pairs.drop("_way")


def score_pairs(pairs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """Corridor, five pillars, weighted score, friction and feasibility of hotspot/candidate pairs.

    ``pairs`` holds two ``prepare_places`` rows side by side (prefixes ``h_`` and ``c_``) and ``straight_km``.
    """
    return _scored(pairs, score_steps(weights, alpha)).drop("_class")


def _best_first() -> list[Column]:
    return [F.col("final_wsm_score").desc(), F.col("c_id").asc()]


def _top_per_class(scored: DataFrame, top_n: int) -> DataFrame:
    """(h_id, c_id, _class, score), at most ``top_n`` rows per hotspot and class.

    Only these four columns are sorted, and the row limit cuts each task's pairs before the shuffle.
    """
    order = Window.partitionBy("h_id", "_class").orderBy(*_best_first())
    narrow = scored.select("h_id", "c_id", "_class", "final_wsm_score")
    return narrow.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top_n).drop("_n")


def _pick_pool(shortlist: DataFrame, top_n: int) -> DataFrame:
    """Apply the pool rules to the per-class lists.

    Regional feasible rows win when they fill the list; else all feasible rows; without any feasible row the same
    choice is made among the infeasible ones. Lists cut at ``top_n`` decide this exactly, because only "fills the
    list" and "is empty" matter.
    """
    hotspot = Window.partitionBy("h_id")

    def size_of(group: int) -> Column:
        return F.sum(F.when(F.col("_class") == group, 1).otherwise(0)).over(hotspot)

    near, far, plain = size_of(FEASIBLE_REGIONAL), size_of(FEASIBLE_FAR), size_of(REGIONAL_ONLY)
    keep = (
        F.when(near >= top_n, F.col("_class") == FEASIBLE_REGIONAL)
        .when(near + far > 0, F.col("_class").isin(FEASIBLE_REGIONAL, FEASIBLE_FAR))
        .when(plain >= top_n, F.col("_class") == REGIONAL_ONLY)
        .otherwise(F.lit(True))
    )
    chosen = shortlist.withColumn("_keep", keep).where("_keep")
    return (
        chosen.withColumn("candidate_rank", F.row_number().over(hotspot.orderBy(*_best_first())))
        .where(F.col("candidate_rank") <= top_n)
        .drop("_keep", "_class")
    )


def _near_pairs(hotspots: DataFrame, candidates: DataFrame, road_km: float, group_rows: int, small: bool) -> DataFrame:
    return radius_join(
        hotspots, candidates, ("h_lat", "h_lon"), ("c_lat", "c_lon"), right_key="c_id", left_key="h_id",
        radius_km=road_km / ROAD_FACTOR_MIN + 0.1, group_rows=group_rows, small_right=small,
    ).where(~same_place())


def _zero_score_fill(hotspots: DataFrame, candidates: DataFrame, top_n: int) -> DataFrame:
    """Pairs for hotspots that may need candidates at any distance.

    All candidates of score 0 tie and the lowest id wins, so the lowest ids overall are enough: with at most ``top_n`` + 1 rows kept per name, the first 2 * ``top_n`` + 2 rows still hold ``top_n`` others
    after a hotspot drops its own id and its own name. That list has a fixed size and rides as one array.
    """
    by_name = Window.partitionBy(F.lower(F.trim(F.col("c_name")))).orderBy("c_id")
    lowest = (
        candidates.withColumn("_n", F.row_number().over(by_name)).where(F.col("_n") <= top_n + 1).drop("_n")
        .orderBy("c_id").limit(2 * top_n + 2)
    )
    packed = lowest.agg(F.collect_list(F.struct(*candidates.columns)))
    return (
        hotspots.withColumn("_c", F.explode(packed.scalar()))
        .select(*hotspots.columns, "_c.*")
        .withColumn("straight_km", haversine_km("h_lat", "h_lon", "c_lat", "c_lon"))
        .where(~same_place())
    )


def _search(
    h: DataFrame, cells: list[DataFrame], placed: DataFrame, top_n: int, weights: dict[str, float], alpha: float,
    score: Callable[[DataFrame], DataFrame], within_km: float | None, classes: tuple[int, ...] = (FEASIBLE_REGIONAL, REGIONAL_ONLY),
) -> DataFrame:
    """(h_id, c_id, _class, score): every pair that may be among the ``top_n`` best of its hotspot, within a road distance or anywhere.

    Within a distance only pairs of ``classes`` count. Pairs of score 0 may be missing where there is no limit.
    """
    size = len(placed.select("c_vec").first()[0])
    plain = F.col("h_raw_tags").isNull() | (F.size("h_tags") == 0)
    asked = cut_lineage(h.select(
        "h_id", "h_lat", "h_lon", "h_need", "h_norm", "h_vec", bounds.tag_bits(F.col("h_tags")).alias("h_bits"), plain.alias("h_plain"),
        F.col("h_station").isNotNull().alias("h_rail"), F.lit(float("-inf") if within_km else LEAST_SCORE).alias("floor"),
    ))

    def scored(leaves: DataFrame) -> DataFrame:
        pairs = leaves.join(placed, ["_x", "_y"]).drop("_x", "_y").join(h, "h_id").where(~same_place())
        found = score(pairs.withColumn("straight_km", haversine_km("h_lat", "h_lon", "c_lat", "c_lon")))
        return found.where(F.col("_class").isin(*classes)) if within_km else found

    first = scored(bounds.descend(asked, cells, weights, alpha, size, within_km, top_n + SEED_LEAVES))
    scores = F.sort_array(F.collect_list("final_wsm_score"), asc=False)  # at most top_n scores for each class
    floors = first.groupBy("h_id").agg(F.get(scores, F.lit(top_n - 1)).alias("_floor"))
    asked = cut_lineage(asked.join(floors, "h_id", "left").withColumn("floor", F.greatest("floor", "_floor")).drop("_floor"))
    return scored(bounds.descend(asked, cells, weights, alpha, size, within_km, None))


def _stranded(
    shortlist: DataFrame, stranded: DataFrame, h: DataFrame, c: DataFrame, top_n: int, weights: dict[str, float], alpha: float,
    score: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The shortlist with that of the hotspots without any feasible candidate: regional ones if they fill the list, else all compete."""
    cells, placed = bounds.pyramid(c, weights)
    own = h.join(stranded, "h_id", "left_semi")
    regional = cut_lineage(_search(own, cells, placed, top_n, weights, alpha, score, REGIONAL_KM))
    filled = regional.groupBy("h_id").count().where(F.col("count") >= top_n)
    short = cut_lineage(own.join(filled, "h_id", "left_anti"))
    if short.isEmpty():
        return shortlist.unionByName(regional)
    anywhere = _search(short, cells, placed, top_n, weights, alpha, score, None)
    lowest = score(_zero_score_fill(short, c, top_n))
    others = anywhere.unionByName(lowest).unionByName(regional.join(short, "h_id", "left_semi")).dropDuplicates(["h_id", "c_id"])
    return shortlist.unionByName(regional.join(filled, "h_id", "left_semi")).unionByName(others)


def match_all(
    hotspots: DataFrame,
    candidates: DataFrame,
    top_n: int = 3,
    weights: dict[str, float] | None = None,
    alpha: float = ALPHA,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Best ``top_n`` candidates of every hotspot; both inputs come from ``prepare_places``.

    Two tiers of growing reach, each against the places that can be feasible at all: the regional reach for all hotspots, the feasible
    reach for those the first tier did not fill. Up to ``group_rows`` places are met by a grid join; more would meet a number of others
    that grows with them, so they are settled by branch and bound over a pyramid of cells, as are hotspots without a feasible candidate. The places and each tier's shortlist (a few rows per hotspot) are checkpointed, so the
    tables behind the places are read once. Shortlists carry ids and scores only; the columns of the chosen pairs are
    worked out at the end. Ids must be unique.
    """
    ready = cut_lineage(candidates)
    c = _side(ready, "c")
    h = _side(ready if hotspots is candidates else cut_lineage(hotspots), "h")

    small = has_at_most(ready, group_rows)
    steps = score_steps(weights, alpha)

    def score(pairs: DataFrame) -> DataFrame:
        return _top_per_class(_scored(pairs, steps), top_n)

    def lacking(shortlist: DataFrame, done: Column) -> DataFrame:
        filled = shortlist.groupBy("h_id").agg(done.alias("_done")).where("_done").select("h_id")
        return h.join(filled, "h_id", "left_anti")

    def count_of(*groups: int) -> Column:
        return F.sum(F.when(F.col("_class").isin(*groups), 1).otherwise(0))

    def feasible(hotspots: DataFrame, road_km: float) -> DataFrame:
        if cells:
            classes = (FEASIBLE_REGIONAL,) if road_km == REGIONAL_KM else (FEASIBLE_REGIONAL, FEASIBLE_FAR)
            return _search(hotspots, cells, placed, top_n, weights or WEIGHTS, alpha, score, road_km, classes)
        found = score(_near_pairs(hotspots, able, road_km, group_rows, small))
        return found.where(F.col("_class").isin(FEASIBLE_REGIONAL, FEASIBLE_FAR))

    able = c.where((F.col("c_gap") > MIN_GAP) & (F.col("c_demand") < F.col("c_eco")))
    bounded = min((weights or WEIGHTS).values()) >= 0 and 0 <= alpha <= 1  # else cells have no bound
    cells, placed = bounds.pyramid(able, weights or WEIGHTS) if bounded and not small else ([], able)
    shortlist = cut_lineage(feasible(h, REGIONAL_KM))
    unfilled = lacking(shortlist, count_of(FEASIBLE_REGIONAL) >= top_n)
    if not unfilled.isEmpty():
        wider = feasible(unfilled, FEASIBLE_KM)
        done = shortlist.join(unfilled.select("h_id"), "h_id", "left_anti")
        shortlist = cut_lineage(done.unionByName(wider))
    stranded = cut_lineage(lacking(shortlist, count_of(FEASIBLE_REGIONAL, FEASIBLE_FAR) > 0).select("h_id"))
    if not stranded.isEmpty():
        shortlist = cut_lineage(_stranded(shortlist, stranded, h, c, top_n, weights or WEIGHTS, alpha, score))
    chosen = _pick_pool(shortlist, top_n).drop("final_wsm_score")
    sides = chosen.join(h, "h_id").join(F.broadcast(c) if small else c, "c_id")
    return _scored(sides.withColumn("straight_km", haversine_km("h_lat", "h_lon", "c_lat", "c_lon")), steps).drop("_class")
