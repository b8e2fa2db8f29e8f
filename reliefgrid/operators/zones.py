"""Sensitive zones: watch list, hotspot alerts and footprints."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.geo import circle_ring, haversine_m
from reliefgrid.functions.text import hotspot_words, zone_words
from reliefgrid.operators.nearby import BLOCK_ROWS, GROUP_ROWS, has_at_most, nearest, nearest_covering, pair_tasks, radius_join
from reliefgrid.session import cut_lineage

# Acute pressure and display reach (m).
ACUTE_PRESSURE = 1.0
DISPLAY_RADIUS_M = 150_000


def zone_records(zones: DataFrame) -> DataFrame:
    """Zone rows with area in km2 and a boolean area flag."""
    return zones.withColumn("gazetted_area_km2", F.col("luas_h") / 100.0).withColumn(
        "area_derived", F.lower(F.trim(F.col("area_derived").cast("string"))) == "true"
    )


def _acute(places: DataFrame) -> DataFrame:
    return places.where(F.col("continuous_pressure") >= ACUTE_PRESSURE)


def _circles(zones: DataFrame) -> DataFrame:
    return zones.select(
        F.col("key").alias("z_key"), F.col("lat").alias("z_lat"), F.col("lon").alias("z_lon"),
        (F.col("radius_m") / 1000.0).alias("z_radius_km"),
    )


def _often(df: DataFrame, column: str, rows: int) -> DataFrame | None:
    """Values in more than ``rows`` rows, null among them, as ``_often``; None where there are none."""
    often = cut_lineage(df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(F.col(column).alias("_often")))
    return None if often.isEmpty() else often


def _names_in_zones(
    places: DataFrame, zones: DataFrame, group_rows: int, reduced: Callable[[DataFrame, list[str], bool], DataFrame]
) -> list[tuple[DataFrame, int, bool]]:
    """What ``reduced`` makes of the (z_key, p_name) pairs of each block, the pairs compared, and whether a pair may come from several
    blocks; one entry for zones whose key is theirs alone, one for keys that zones share.

    ``reduced`` is told by which columns its pairs lie together and whether a pair may come twice. Places of one name share a block, so
    that their pairs are made distinct without a shuffle; names at more positions than a block holds spread over several.
    """
    spots = cut_lineage(_acute(places).select(
        F.col("destination_name").alias("p_name"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"),
    ).distinct())
    circles = cut_lineage(_circles(zones).distinct())
    again = _often(spots, "p_name", 1) is not None
    crowded, shared = _often(spots, "p_name", BLOCK_ROWS), _often(circles, "z_key", 1)
    spread = F.lit(0)
    if crowded is not None:
        spots = spots.join(crowded, F.col("p_name").eqNullSafe(F.col("_often")), "left").withColumn(
            "_hot", F.col("_often").isNotNull() | F.col("p_name").isNull()
        ).drop("_often")
        spread = F.when(F.col("_hot"), F.xxhash64("p_lat", "p_lon")).otherwise(0)
    spots = spots.withColumn("_name", F.xxhash64("p_name", spread))
    parts = [(circles, False)]
    if shared is not None:
        same = F.col("z_key").eqNullSafe(F.col("_often"))
        parts = [(circles.join(shared, same, "left_anti"), False), (circles.join(shared, same, "left_semi"), True)]
    out = []
    for own, shares in parts:
        compared = []

        def block(pairs: DataFrame, keys: list[str], number: int) -> DataFrame:
            compared.append(number)
            return reduced(pairs, keys, again or shares)

        found = radius_join(
            spots, own, ("p_lat", "p_lon"), ("z_lat", "z_lon"), right_key="z_key", left_key="_name", radius_column="z_radius_km",
            group_rows=group_rows, per_block=block,
        )
        out.append((found, sum(compared), shares or crowded is not None))
    return out


def watched_names(places: DataFrame, zones: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(z_key, p_name): the acute places of each zone, one row per name; the form to work on, however wide a zone is.

    A name at one position meets each zone once. The positions of a name that has several lie together in one row, which meets a zone
    once, too, so that no pair is sent or kept to be made distinct, except those of keys that zones share and of names at more positions
    than a block holds.
    """
    spots = cut_lineage(_acute(places).select(
        F.col("destination_name").alias("p_name"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"),
    ).distinct())
    circles = cut_lineage(_circles(zones).distinct())
    # names at one position, at several, and at more than a block holds; null is a name
    sides = [(spots, "p_name", None, False)]
    often = spots.groupBy("p_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    often = cut_lineage(often.select(F.col("p_name").alias("_often"), F.ceil(F.col("_n") / BLOCK_ROWS).alias("_parts")))
    if not often.isEmpty():
        same = F.col("p_name").eqNullSafe(F.col("_often"))
        several = cut_lineage(spots.join(often, same).withColumn(
            "_part", F.xxhash64("p_name", F.pmod(F.xxhash64("p_lat", "p_lon"), F.col("_parts")))
        ).drop("_often"))
        sides = [
            (spots.join(often, same, "left_anti"), "p_name", None, False),
            (several.where(F.col("_parts") == 1), "p_name", ["p_name"], False),
            (several.where(F.col("_parts") > 1), "_part", ["p_name", "_part"], True),
        ]
        sides = [(cut_lineage(side), *how) for side, *how in sides]
        sides = [side for side in sides if not side[0].isEmpty()]
    shared = _often(circles, "z_key", 1)
    parts = [(circles, False)]
    if shared is not None:
        same = F.col("z_key").eqNullSafe(F.col("_often"))
        parts = [(cut_lineage(circles.join(shared, same, how)), shares) for how, shares in (("left_anti", False), ("left_semi", True))]
    found = []
    for own, shares in parts:
        small = has_at_most(own, group_rows)
        for side, left_key, gathered, scattered in sides:
            pairs = radius_join(
                side, own, ("p_lat", "p_lon"), ("z_lat", "z_lon"), right_key="z_key", left_key=left_key, radius_column="z_radius_km",
                group_rows=group_rows, small_right=small, gathered=gathered,
            ).select("z_key", "p_name")
            found.append(pairs.distinct() if shares or scattered else pairs)
    return reduce(DataFrame.unionByName, found)


def watch_list(places: DataFrame, zones: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Zones that hold at least one acute place, with the place names and their number, for display.

    Names are collected where the places of a zone are found, so that lists are shuffled and not pairs, in as many tasks as the
    pairs need. A list grows with names and not with rows.
    """

    def lists_of(pairs: DataFrame, keys: list[str], again: bool) -> DataFrame:
        collect = F.collect_set if again else F.collect_list
        return pairs.groupBy(*keys, "z_key").agg(collect(F.struct("p_name")).alias("_names"))

    found = _names_in_zones(places, zones, group_rows, lists_of)
    tasks = pair_tasks(sum(compared for _, compared, _ in found), finer=5)  # of five pairs compared some two are kept at most
    watched = reduce(DataFrame.unionByName, [lists for lists, *_ in found])
    if tasks > 1:
        watched = watched.repartition(tasks, "z_key")
    names = F.flatten(F.collect_list("_names"))
    if any(scattered for *_, scattered in found):
        names = F.array_distinct(names)
    watched = watched.groupBy("z_key").agg(names.alias("_names")).select(
        "z_key", F.sort_array(F.filter(F.col("_names")["p_name"], lambda n: n.isNotNull())).alias("watch_districts"),
        F.size("_names").cast("long").alias("watch_count"),
    )
    return zones.hint("shuffle_hash").join(watched, zones["key"] == watched["z_key"]).drop("z_key")


def _nearest_namesake(places: DataFrame, zones: DataFrame, group_rows: int) -> DataFrame:
    """(p_id, z_key, dist_m): the nearest zone that shares a significant name word with the place.

    Both sides are exploded to words and meet on word and grid cell with a growing circle, so a word that a third of
    the names carry never pairs all of its places with all of its zones.
    """
    place_words = places.select(
        F.col("destination_id").alias("p_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"),
        F.explode(hotspot_words("destination_name")).alias("word"),
    )
    zone_tokens = zones.select(
        F.col("key").alias("z_key"), F.col("lat").alias("z_lat"), F.col("lon").alias("z_lon"),
        F.explode(zone_words("nama", "daerah")).alias("word"),
    )
    shared = place_words.join(zone_tokens.select("word").distinct(), "word", "left_semi")
    return nearest(
        shared, zone_tokens, "p_id", ("p_lat", "p_lon"), "z_key", ("z_lat", "z_lon"), on=["word"], group_rows=group_rows
    ).select("p_id", F.col("nearest_z_key").alias("z_key"), (F.col("nearest_km") * 1000.0).alias("dist_m"))


def hotspot_alerts(places: DataFrame, zones: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The single alerting zone of every place: by shared name word or proximity, the nearest (then key) kept.

    Of the zones that hold a place and of its namesakes only the nearest come out of their joins.
    """
    places, zones = places.where(F.col("destination_id").isNotNull()), zones.where(F.col("key").isNotNull())
    spots = places.select(F.col("destination_id").alias("p_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    near = nearest_covering(
        spots, _circles(zones), "p_id", ("p_lat", "p_lon"), "z_key", ("z_lat", "z_lon"), "z_radius_km", group_rows=group_rows
    )
    closest = F.min(F.struct("dist_m", "z_key"))
    return near.unionByName(_nearest_namesake(places, zones, group_rows)).groupBy("p_id").agg(closest.alias("_a")).select(
        F.col("p_id").alias("destination_id"), F.col("_a.z_key").alias("key"), F.col("_a.dist_m").alias("dist_m")
    )


def display_zones(
    places: DataFrame, zones: DataFrame, alerts: DataFrame, watched: DataFrame, reach_m: float = DISPLAY_RADIUS_M,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(destination_id, key, is_alert): what a map of each place shows.

    A place shows the zones within the catchment and its own alert at any distance. Watch zones show on every map;
    they come once, with a null destination_id, instead of once per place.
    """
    spots = places.select(F.col("destination_id").alias("p_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    circles = zones.select(F.col("key").alias("z_key"), F.col("lat").alias("z_lat"), F.col("lon").alias("z_lon"))
    everywhere = cut_lineage(watched.select("key"))
    own = cut_lineage(alerts.select("destination_id", "key"))
    # watch zones leave before the join: they would meet every place of their catchment for nothing
    unwatched = cut_lineage(circles.join(everywhere, F.col("z_key") == F.col("key"), "left_anti"))
    inside = radius_join(
        spots, unwatched, ("p_lat", "p_lon"), ("z_lat", "z_lon"), right_key="z_key", left_key="p_id",
        radius_km=reach_m / 1000.0, group_rows=group_rows,
    ).select(F.col("p_id").alias("destination_id"), F.col("z_key").alias("key"))
    alerting = own.join(everywhere, "key", "left_anti").select("destination_id", "key")
    return (
        inside.unionByName(alerting).distinct()
        .join(alerting.withColumn("is_alert", F.lit(True)), ["destination_id", "key"], "left")
        .select("destination_id", "key", F.coalesce("is_alert", F.lit(False)).alias("is_alert"))
        .unionByName(
            everywhere.select(F.lit(None).cast("bigint").alias("destination_id"), "key", F.lit(True).alias("is_alert"))
        )
    )


def footprints(zones: DataFrame, segments: int = 64) -> DataFrame:
    return zones.withColumn("ring", circle_ring("lat", "lon", "radius_m", segments))
