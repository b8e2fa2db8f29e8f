"""Archetype vectors, tag sets and their similarity."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import as_col, clip, or_default

ARCHETYPES = ["arch_heritage", "arch_nature", "arch_beach", "arch_food", "arch_urban"]
# Display names of the five archetypes.
ARCHETYPE_LABELS = [
    "Heritage & Culture",
    "Eco-Nature & Highlands",
    "Coastal & Marine",
    "Gastronomy & Agri-Tourism",
    "Urban & Integrated Leisure",
]


def tag_set(raw: Column | str) -> Column:
    """Clean lower-case tags from a delimited or list-like string; empty for blank markers."""
    text = F.trim(as_col(raw))
    blank = text.isNull() | F.lower(text).isin("", "nan", "none", "null", "[]", "set()", "{}")
    bracketed = F.split(F.regexp_replace(text, r"^\[|\]$|[\"']", ""), ",")
    parts = (
        F.when(text.startswith("[") & text.endswith("]"), bracketed)
        .when(text.contains("|"), F.split(text, r"\|"))
        .when(text.contains(";"), F.split(text, ";"))
        .otherwise(F.split(text, ","))
    )
    clean = F.filter(F.transform(parts, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.array_distinct(clean))


# Bits of a tag bitmap: with more different tags two may share a bit.
TAG_BITS = 512


class TagBits(NamedTuple):
    """A tag set as bitmap words and its size; ``tags`` is the set itself where two tags may share a bit, else null."""

    words: list[Column]
    size: Column
    tags: Column | None = None


def known_tags(df: DataFrame, tags: str) -> list[str] | None:
    """The different tags of a column of tag sets, None if there are more than ``TAG_BITS``."""
    found = [r[0] for r in df.select(F.explode(tags)).distinct().limit(TAG_BITS + 1).collect()]
    return sorted(found) if len(found) <= TAG_BITS else None


def tag_words(df: DataFrame, tags: str, known: list[str] | None, prefix: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the bitmap of ``tags`` as long columns, and their names; ``known`` as ``known_tags`` gives them."""
    bits = TAG_BITS if known is None else len(known)
    names = [f"{prefix}{k}" for k in range(max(1, -(-bits // 64)))]
    if known is None:
        place = lambda t: F.pmod(F.xxhash64(t), F.lit(bits)).cast("int")
    else:
        listed = F.array(*[F.lit(t) for t in known]).cast("array<string>")
        place = lambda t: (F.array_position(listed, t) - 1).cast("int")
    df = df.withColumn("_bits", F.transform(tags, place))

    def word(k: int) -> Column:
        own = F.filter("_bits", lambda b: F.floor(b / 64) == k)
        one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)
        return F.aggregate(own, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(one(b)))

    return df.withColumns({name: word(k) for k, name in enumerate(names)}).drop("_bits"), names


def archetype_entries(columns: list[str] | None = None) -> list[Column]:
    """Entries with missing values at 0.5, each in [0, 1]."""
    return [clip(or_default(c, 0.5), 0.0, 1.0) for c in (columns or ARCHETYPES)]


def archetype_vector(columns: list[str] | None = None) -> Column:
    """array<double> with missing values at 0.5 and every entry in [0, 1]."""
    return F.array(*archetype_entries(columns))


def dot(a: Column | list[Column], b: Column | list[Column]) -> Column:
    """Of two arrays, or of two lists of columns: these are compiled, which functions over arrays are not."""
    if isinstance(a, list):
        return reduce(lambda s, xy: s + xy[0].cast("double") * xy[1].cast("double"), zip(a, b, strict=True), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column | list[Column], b: Column | list[Column]) -> Column:
    """Cosine of two arrays, or lists of columns, in [0, 1]; 0 when either has no length."""
    return cosine_with_norms(a, b, F.sqrt(dot(a, a)), F.sqrt(dot(b, b)))


def cosine_with_norms(a: Column | list[Column], b: Column | list[Column], norm_a: Column, norm_b: Column) -> Column:
    valid = (norm_a > 1e-9) & (norm_b > 1e-9)
    return F.when(valid, clip(dot(a, b) / (norm_a * norm_b), 0.0, 1.0)).otherwise(F.lit(0.0))


def tag_count(a: Column | TagBits) -> Column:
    return a.size if isinstance(a, TagBits) else F.size(a)


def shared_tags(a: Column | TagBits, b: Column | TagBits) -> Column:
    """Number of tags that two sets share; sets whose tags may share bits are compared in full where their bitmaps meet."""
    if not isinstance(a, TagBits):
        return F.size(F.array_intersect(a, b))
    both = [x.bitwiseAND(y) for x, y in zip(a.words, b.words, strict=True)]
    if a.tags is None:
        return reduce(Column.__add__, [F.bit_count(x) for x in both])
    return F.when(reduce(Column.bitwiseOR, both) == 0, F.lit(0)).otherwise(F.size(F.array_intersect(a.tags, b.tags)))


def jaccard(a: Column | TagBits, b: Column | TagBits) -> Column:
    """Overlap of two tag arrays, or bitmaps; 0 when either is empty."""
    both = shared_tags(a, b).cast("double")
    total = tag_count(a) + tag_count(b) - both
    return F.when((tag_count(a) > 0) & (tag_count(b) > 0), both / total).otherwise(F.lit(0.0))


def hybrid(
    cos: Column, raw_a: Column, raw_b: Column, tags_a: Column | TagBits, tags_b: Column | TagBits, alpha: float = 0.60
) -> Column:
    """alpha * cosine + (1 - alpha) * jaccard; cosine alone when tags are absent."""
    no_tags = raw_a.isNull() | raw_b.isNull() | ((tag_count(tags_a) == 0) & (tag_count(tags_b) == 0))
    mixed = clip(cos * alpha + jaccard(tags_a, tags_b) * (1.0 - alpha), 0.0, 1.0)
    return F.when(no_tags, cos).otherwise(mixed)


def leading_tags(raw: Column | str, count: int = 3) -> Column:
    """First tags of a ``|`` list as readable text."""
    parts = F.filter(F.transform(F.split(as_col(raw), r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    return F.array_join(F.transform(F.slice(parts, 1, count), lambda t: F.replace(t, F.lit("_"), F.lit(" "))), ", ")
