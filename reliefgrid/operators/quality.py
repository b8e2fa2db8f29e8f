"""Rules as boolean columns, violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.geo import radius_from_hectares
from reliefgrid.functions.text import literal_map, protection_class, zone_type_number
from reliefgrid.operators.interest import MONTH_NAMES
from reliefgrid.operators.ranking import missing_from, repeated_keys

# The fifteen zone types.
ZONE_TYPES = {
    1: "Hutan Simpanan Kekal (HSK)",
    2: "Kawasan Bukit, Tanah Tinggi dan Kawasan Cerun",
    3: "Kawasan Simpanan Mineral",
    4: "Kawasan Risiko Bencana",
    5: "Warisan Kebudayaan Ketara dan Warisan Semula Jadi",
    6: "Kawasan Perlindungan Hidupan Liar",
    7: "Kawasan Empangan, Tadahan Air dan Imbuhan Air Bawah Tanah",
    8: "Dataran Banjir",
    9: "Tanah Bencah dan Tanah Gambut",
    10: "Tasik dan Sungai",
    11: "Kawasan Persisiran Pantai",
    12: "Kawasan Perlindungan Marin",
    13: "Kawasan Keterjaminan Makanan",
    14: "Kawasan Bekas Lombong dan Kuari",
    15: "Bekas dan Tapak Pelupusan Sisa Pepejal",
}
# Protection classes each zone type may carry.
LEGAL_CLASSES = {
    1: [1, 2],
    2: [1, 2, 3],
    3: [3],
    4: [1, 2, 3],
    5: [2],
    6: [1, 2],
    7: [1, 3],
    8: [2],
    9: [1, 2],
    10: [3],
    11: [1, 2, 3],
    12: [1, 2],
    13: [1, 3],
    14: [2],
    15: [3],
}
# Bounds of the zone table.
LAT_BOUNDS = (0.8, 7.6)
LON_BOUNDS = (99.0, 119.6)
RADIUS_BOUNDS = (1000, 40000)
YEAR_BOUNDS = (2000, 2030)
ZONE_COLUMNS = ["ksas_code", "jenis_ksas", "tahap", "nama", "akt_1", "akt_0", "negeri", "daerah", "tahun_data", "lat", "lon",
                "radius_m", "sumber", "representation"]
INTEREST_COLUMNS = ["destination", "category", "relative_search_index", "peak_month", "dominant_query"]


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def row_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every row and rule whose condition is not true; null counts as a violation."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(broken)).alias("rule"))


def key_violations(df: DataFrame, key: str) -> DataFrame:
    return repeated_keys(df, [key]).select(F.col(key).cast("string").alias("key"), F.lit("unique key").alias("rule"))


def _read_zones(zones: DataFrame) -> DataFrame:
    """Parsed code, class, area and radius, each worked out once for all rules."""
    return zones.withColumns(
        {
            "_type": zone_type_number("ksas_code"),
            "_class": protection_class("tahap"),
            "_area": F.col("luas_h").try_cast("double"),
            "_radius": F.col("radius_m").try_cast("double"),
        }
    ).withColumn("_expected", F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONE_TYPES.items() for x in kv]), "_type"))


def zone_rules() -> dict[str, Column]:
    """Conditions over ``_read_zones`` rows."""
    number, cls, expected = F.col("_type"), F.col("_class"), F.col("_expected")
    given = F.trim("jenis_ksas")
    stem = F.lower(F.trim(F.substring_index(expected, "(", 1)))
    legal = F.lit(False)
    for zone_type, classes in LEGAL_CLASSES.items():
        legal = F.when(number == zone_type, cls.isin(*classes)).otherwise(legal)
    area, radius = F.col("_area"), F.col("_radius")
    derived = F.lower(F.trim(F.col("area_derived").cast("string"))) == "true"
    return {
        "type code": number.isNotNull(),
        "protection class": cls.isNotNull(),
        "type name": F.contains(F.lower(given), stem) | F.contains(F.lower(expected), F.lower(given)),
        "class legal for type": legal,
        "area known": area.isNotNull() | F.coalesce(F.lower(F.trim("keyakinan")) == "wakil", F.lit(False)),
        "area positive": area.isNull() | (area > 0),
        "latitude": F.col("lat").try_cast("double").between(*LAT_BOUNDS),
        "longitude": F.col("lon").try_cast("double").between(*LON_BOUNDS),
        "radius range": radius.between(*RADIUS_BOUNDS),
        "radius step": radius % 500 == 0,
        "radius fits area": ~F.coalesce(derived, F.lit(False)) | (F.abs(radius - radius_from_hectares(area)) <= 500),
        "year": F.col("tahun_data").try_cast("int").between(*YEAR_BOUNDS),
    }


def zone_violations(zones: DataFrame) -> DataFrame:
    require_columns(zones, ZONE_COLUMNS)
    return row_violations(_read_zones(zones), "key", zone_rules()).unionByName(key_violations(zones, "key"))


def uncovered_types(zones: DataFrame) -> DataFrame:
    """Zone types without any row: a warning, not an error."""
    every = F.explode(F.sequence(F.lit(1), F.lit(15))).alias("zone_type")
    seen = F.collect_set(zone_type_number("ksas_code"))  # at most fifteen values
    return zones.agg(seen.alias("_s")).select("_s", every).where(~F.array_contains("_s", F.col("zone_type"))).select("zone_type")


def clean_zones(zones: DataFrame) -> DataFrame:
    """Canonical code and class text on valid rows."""
    return zones.withColumns(
        {
            "ksas_code": F.concat(F.lit("KSAS "), zone_type_number("ksas_code").cast("string")),
            "tahap": F.concat(F.lit("Tahap "), protection_class("tahap").cast("string")),
        }
    )


def interest_violations(table: DataFrame, places: DataFrame, min_rows: int = 50) -> DataFrame:
    """Rule violations of a search-interest table; names must exist in ``places``."""
    require_columns(table, INTEREST_COLUMNS)
    rules = {
        "index range": F.col("relative_search_index").between(0.0, 100.0),
        "month name": F.col("peak_month").isin(*MONTH_NAMES),
        "category": F.col("category").isin("Hotspot", "Alternative"),
        "query not blank": F.trim("dominant_query") != "",
    }
    unknown = missing_from(table, places, "destination", "destination_name").select(
        F.col("destination").alias("key"), F.lit("known destination").alias("rule")
    )
    short = table.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < min_rows).select(
        F.col("_n").cast("string").alias("key"), F.lit("row count").alias("rule")
    )
    return (
        row_violations(table, "destination", rules).unionByName(key_violations(table, "destination"))
        .unionByName(unknown).unionByName(short)
    )


def guest_total_violations(guests: DataFrame) -> DataFrame:
    """Guest rows whose total is not domestic plus foreign, and rows where any of the three is missing."""
    return guests.where(~F.coalesce(F.col("total_guests") == F.col("domestic_guests") + F.col("foreign_guests"), F.lit(False)))


def require_clean(df: DataFrame, violations: DataFrame) -> DataFrame:
    """``df``, with an error at run time when any violation exists."""
    sample = violations.orderBy("rule", "key").limit(5).agg(
        F.array_join(F.collect_list(F.concat_ws(": ", "rule", "key")), "; ").alias("_v")
    )
    fine = F.assert_true(sample.scalar() == "", sample.scalar())
    return df.where(fine.isNull())


def observed(df: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """Same rows, with violation counters reported through ``observe`` while the data flows by."""
    counts = [F.sum(F.when(~F.coalesce(ok, F.lit(False)), 1).otherwise(0)).alias(rule.replace(" ", "_")) for rule, ok in rules.items()]
    return df.observe(name, F.count(F.lit(1)).alias("row_count"), *counts)


def type_name(number: Column) -> Column:
    return F.try_element_at(literal_map({str(k): v for k, v in ZONE_TYPES.items()}), number.cast("string"))


def table_digest(df: DataFrame, keys: list[str], buckets: int = 256) -> DataFrame:
    """_bucket, _rows, _sum, _xor: a fingerprint of each bucket of keys that no order of the rows changes.

    Rows are hashed in the tasks and only sums are shuffled, a row for each bucket.
    """
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in sorted(df.columns)])
    marked = df.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"), row.alias("_h"))
    return marked.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_sum"), F.bit_xor("_h").alias("_xor")
    )


def differences(left: DataFrame, right: DataFrame, keys: list[str], buckets: int = 256) -> DataFrame:
    """keys, change ('removed', 'added', 'changed') of two tables with unique keys; only rows of differing buckets are joined."""
    marks = ["_rows", "_sum", "_xor"]
    a, b = table_digest(left, keys, buckets), table_digest(right, keys, buckets).withColumnsRenamed({m: f"{m}b" for m in marks})
    same = F.lit(True)
    for m in marks:
        same = same & F.col(m).eqNullSafe(F.col(f"{m}b"))
    # at most ``buckets`` rows
    differing = F.broadcast(a.join(b, "_bucket", "full").where(~same).select("_bucket"))

    def suspects(df: DataFrame, side: str) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in keys)
        row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(True)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        return df.withColumn("_bucket", bucket).join(differing, "_bucket", "left_semi").select(*keys, row.alias(side), F.lit(True).alias(f"_in_{side}"))

    both = suspects(left, "_l").join(suspects(right, "_r"), keys, "full")
    change = F.when(F.col("_in__r").isNull(), "removed").when(F.col("_in__l").isNull(), "added").when(~F.col("_l").eqNullSafe(F.col("_r")), "changed")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")
