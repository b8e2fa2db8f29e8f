"""Equi-join lookups: validated merges, defaults, fallbacks and memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.text import CLUSTER_NAMES, REGION_CLUSTERS, STATES, state_name
from reliefgrid.operators.ranking import repeated_keys


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join that fails at run time when either side repeats a key.

    Each side is grouped by the key first, which is the shuffle the join needs anyway; a group of two raises.
    """

    def unique(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        check = F.assert_true(F.count(F.lit(1)) == 1, F.concat(F.lit(f"repeated {key}: "), F.first(key).cast("string")))
        grouped = df.groupBy(key).agg(*[F.first(c).alias(c) for c in rest], check.alias("_one"))
        return grouped.where(F.col("_one").isNull()).drop("_one")

    return unique(left).join(unique(right), key, how)


def merge_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that break a one-to-one merge, as rows instead of an error."""
    return repeated_keys(left, [key]).withColumn("side", F.lit("left")).unionByName(
        repeated_keys(right, [key]).withColumn("side", F.lit("right"))
    )


def lookup(df: DataFrame, table: DataFrame, key: str, defaults: dict[str, object], normalise: bool = False) -> DataFrame:
    """Left join with constant defaults; ``normalise`` brings both keys to canonical state names first."""
    wanted = table.select(key, *defaults)
    if normalise:
        wanted = wanted.withColumn(key, state_name(key))
        df = df.withColumn(key, state_name(key))
    clean = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()]
    return df.join(wanted, key, "left").select(*df.columns, *clean)


def last_value_lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, order: str, default: float = 0.0) -> DataFrame:
    """Left join to the last row (by ``order``) of every key; ``default`` when the key is unknown."""
    last = table.groupBy(*keys).agg(F.max_by(value, order).alias(value))
    return df.join(last, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def prefer_first(df: DataFrame, group: list[str], label: str, preferred: str, fallback: str) -> DataFrame:
    """Rows of the preferred label where the group has any, else rows of the fallback label."""
    has = df.groupBy(*group).agg(F.max(F.when(F.col(label) == preferred, 1).otherwise(0)).alias("_has"))
    wanted = F.when(F.col("_has") == 1, F.lit(preferred)).otherwise(F.lit(fallback))
    return df.join(has, group).where(F.col(label) == wanted).drop("_has")


def latest_rows(df: DataFrame, order: str) -> DataFrame:
    """Rows of the latest snapshot."""
    return df.where(F.col(order) == df.agg(F.max(order)).scalar())


def cluster_states(name: Column) -> Column:
    """Array of member states for a cluster name or alias; empty when unknown."""
    members = {
        **REGION_CLUSTERS,
        "West Coast": REGION_CLUSTERS["Northern"] + REGION_CLUSTERS["Central"] + REGION_CLUSTERS["Southern"],
        "All": STATES,
    }
    key = F.lower(F.regexp_replace(F.trim(name), "[-_]", " "))
    out = F.array().cast("array<string>")
    for cluster, aliases in CLUSTER_NAMES.items():
        out = F.when(key.isin(*aliases), F.array(*[F.lit(s) for s in members[cluster]])).otherwise(out)
    return F.when(name.isNotNull(), out).otherwise(F.array().cast("array<string>"))


def in_cluster(df: DataFrame, state: str, cluster: str) -> DataFrame:
    return df.where(F.array_contains(cluster_states(F.lit(cluster)), F.col(state)))


def unmatched(df: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(reference.select(*keys).distinct(), keys, "left_anti")


def require_match(df: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Lookup where an unknown key is an error, such as the local authority of a district."""
    message = F.concat(F.lit("no match for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    joined = df.join(reference.select(*keys, value), keys, "left")
    return joined.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(message)).otherwise(F.col(value)))
