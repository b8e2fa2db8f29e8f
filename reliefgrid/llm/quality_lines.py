"""Quality rules: counts on each text, then lines that too many documents of a host carry.

Normalised lines are hashed; for each host the documents that carry a line are counted, and lines above the host's limit are
removed. A document of which too little is left is rejected. Everything is a DataFrame expression.

Documents of equal text are counted once for a line, and once for their host: exact copies do not make a line common. Nothing else
exempts a line, so headers of several lines go whole.

Defined results: a null text or host is an empty one; a text without words fails the base rules; each row is one document, also
when rows repeat or share an id; an empty table gives an empty table; columns other than ``doc_id``, ``text`` and ``source`` are
not looked at, whatever their names (``apply_rules`` hands them on).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.stored import join_counted, stored

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_DOCS = 5
MAX_HOST_SHARE = 0.05
MIN_LEFT_SHARE = 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def repeat_words(words: Column) -> Column:
    """Words in windows of eight words that the text holds twice or more."""

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        )

    def covered(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(
            s, lambda p, i: (F.get(s, i - 1)["x"] == p["x"]) | F.coalesce(F.get(s, i + 1)["x"] == p["x"], F.lit(False))
        ))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda p: p["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    def counted(w: Column) -> Column:
        return let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), lambda win: F.when(
            F.size(F.array_distinct(win)) == F.size(win), F.lit(0)
        ).otherwise(covered(win)))

    return let(words, lambda w: F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(counted(w)))


def normal_line(line: Column) -> Column:
    """Lower case A-Z, every number as 0, single blanks."""
    line = F.regexp_replace(F.translate(line, UPPER, LOWER), "[0-9]+", "0")
    return F.regexp_replace(F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+", " ")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def line_records(text: Column) -> Column:
    """A record for each worded line: hash of its normal form, number of words; first: no earlier same line."""
    hashed = F.transform(worded_lines(text), lambda line: F.struct(
        F.xxhash64(normal_line(line)).alias("h"), F.size(words_of(line)).alias("n")
    ))
    return let(F.sort_array(hashed), lambda s: F.transform(s, lambda x, i: F.struct(
        x["h"].alias("h"), x["n"].alias("n"), F.coalesce(F.get(s, i - 1)["h"] != x["h"], F.lit(True)).alias("first"),
    )))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host, key (of the row's content), the counts and the line records."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("host"), text.alias("text"))
    solid = F.length(F.translate(F.col("text"), " \t\n\x0b\f\r", ""))
    words = words_of(F.col("text"))
    return row.select(
        "doc_id", "host", F.xxhash64("host", "text").alias("key"),
        F.size(words).cast("long").alias("n_words"),
        solid.cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate(F.col("text"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(worded_lines(F.col("text")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words).cast("long").alias("n_repeat_words"),
        line_records(F.col("text")).alias("lines"),
    )


def frequent_lines(base: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """host, h of the lines that too many different documents of their host carry."""
    # a text is counted once: by the first of its rows
    texts = base.groupBy("key").agg(F.min("row").alias("row")).select("row")
    different = base.join(texts, "row", "left_semi")
    hosts = stored(different.groupBy("host").agg(F.count("*").alias("host_docs")), "hosts")
    lines = different.select("host", F.inline("lines")).where("first")
    counted = lines.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    limited = join_counted(counted, hosts, ["host"], "inner", hosts.count(), F.col("h"))
    return limited.where(F.col("docs") > max_share * F.col("host_docs")).select("host", "h")


def quality_verdicts(
    docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_docs: int = MIN_DOCS,
    max_share: float = MAX_HOST_SHARE, min_left_share: float = MIN_LEFT_SHARE,
) -> DataFrame:
    """One row for each document: its counts, base_failed, n_removed words, removed line hashes, kept; and key, to find the row again."""
    base = stored(base_counts(docs).withColumn("row", F.monotonically_increasing_id()), "quality")
    lines = base.select("row", "host", F.inline("lines"))
    common = stored(frequent_lines(base, min_docs, max_share), "common-lines")
    removed = (
        join_counted(lines, common, ["host", "h"], "inner", common.count(), F.col("row"))
        .groupBy("row").agg(F.sum("n").alias("n_removed"), F.collect_set("h").alias("removed"))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed") < min_left_share * F.col("n_words")
    return (
        base.drop("lines").join(removed, "row", "left")
        .withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~depleted)
        .drop("row")
    )


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """The kept documents, in all their columns, without their common lines; n_chars, where there is one, is counted anew."""
    verdicts = quality_verdicts(docs, **limits).where("kept").select(
        F.col("doc_id").alias("id"), "key", "removed"
    ).groupBy("id", "key").agg(F.first("removed").alias("removed"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    key = F.xxhash64(F.coalesce("d.source", F.lit("")), F.coalesce("d.text", F.lit("")))
    joined = rows.withColumn("key", key).join(
        verdicts.withColumnRenamed("key", "vkey"), (F.col("key") == F.col("vkey")) & F.col("d.doc_id").eqNullSafe(F.col("id"))
    )
    left = F.array_join(F.filter(
        F.split("d.text", "\n"), lambda line: ~(line.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("removed", F.xxhash64(normal_line(line))))
    ), "\n")
    text = F.when(F.col("removed").isNull(), F.col("d.text")).otherwise(left)
    changed = joined.select("d", text.alias("text"))
    return changed.select(*[
        F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("d").getField(c).alias(c)
        for c in docs.columns
    ])
