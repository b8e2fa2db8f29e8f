"""Names that lines mention: sequences of a line's words looked up in a table of aliases, in one pass for any number of aliases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ALIASES = 100_000  # longer lists are joined by a shuffle
_PART = r"\w+|\W"


def _fold(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def line_parts(line: Column | str) -> Column:
    """Words of ASCII letters, digits and '_', and each other character between them, with A-Z in lower case."""
    return F.regexp_extract_all(_fold(F.col(line) if isinstance(line, str) else line), F.lit(_PART), F.lit(0))


def sequences(parts: Column, length: int) -> Column:
    """Texts of ``length`` neighbouring parts that stand between other characters, or the ends of the line."""

    def open_at(k: Column) -> Column:
        return ~F.coalesce(F.get(parts, k).rlike(r"^\w"), F.lit(False))

    starts = F.when(F.size(parts) >= length, F.sequence(F.lit(0), F.size(parts) - length)).otherwise(F.array().cast("array<int>"))
    alone = F.filter(starts, lambda k: F.when(k == 0, True).otherwise(open_at(k - 1)) & open_at(k + length))
    return F.transform(alone, lambda k: F.array_join(F.slice(parts, k + 1, length), ""))


def alias_table(spark: SparkSession, aliases: list[tuple[str, str]]) -> DataFrame:
    """(alias, name, place): the first name of each alias and its place in the list."""
    first: dict[str, tuple[str, int]] = {}
    for place, (alias, name) in enumerate(aliases):
        first.setdefault(re.sub("[A-Z]", lambda m: m.group().lower(), alias), (name, place))
    return spark.createDataFrame([(a, *v) for a, v in first.items()], "alias string, name string, place int")


def with_first_alias(lines: DataFrame, aliases: list[tuple[str, str]], into: str, line: str = "line") -> DataFrame:
    """The lines that mention some alias as whole words, in any case, with the name of the one that comes first in the list.

    A line that mentions none, a null and an empty line give no row; equal rows give one row. Aliases must not be empty.
    """
    if not all(alias for alias, _ in aliases):
        raise ValueError("an alias is empty")
    table = alias_table(lines.sparkSession, aliases)
    # a word of one part always stands alone, so the parts themselves are looked up; single signs and longer aliases are tested
    single = re.compile(r"\w+", re.ASCII)
    lengths = sorted({len(re.findall(_PART, alias, re.ASCII | re.DOTALL)) for alias, _ in aliases if not single.fullmatch(alias)})
    parted = lines.withColumn("_parts", line_parts(line))
    one_word = F.col("_parts") if 1 not in lengths else F.filter("_parts", lambda x: x.rlike(r"^\w"))
    looked_up = F.array_distinct(F.concat(one_word, *[sequences(F.col("_parts"), n) for n in lengths]))
    spread = parted.withColumn("_alias", F.explode(looked_up)).drop("_parts")
    found = spread.join(F.broadcast(table) if len(aliases) <= BROADCAST_ALIASES else table, spread["_alias"] == table["alias"])
    return found.groupBy(*lines.columns).agg(F.min_by("name", "place").alias(into))
