"""Temperature mixing of sources: weights are token shares to a power, realised as block permutations within a token budget.

The exponent is bisected so that the mix has a target entropy, or so that no source is repeated more often than a limit. Each job
works out six bisections at once: it sums over sources at all 63 exponents that they can visit, so that only 63 rows reach the driver,
however many sources there are. Exponent 1 keeps the shares as they are, exponent 0 makes all sources equal.

A source's budget is its weight times the whole budget: as many whole passes as fit, then a part of one more. The part is a
permutation in blocks: documents are dealt into blocks of bounded size, blocks follow one another in the order of a keyed digest, and
documents within a block likewise; the part ends with the document whose first token still lies within the budget. So only one block
of a source is ever cut, and no source, however large, is ordered in one task. Everything is a DataFrame expression.

Defined results: a null source is a source of its own kind, null; a null text has no tokens, and a document without tokens is in every
whole pass, and in the part if its turn comes; rows that repeat are documents of their own, but share their place in the order, so
that both come or, at the budget's end, both in turn; an empty table gives an empty table; columns beyond ``doc_id``, ``text`` and
``source`` are not looked at (``mixed_documents`` hands them on).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefgrid.llm.quality_lines import words_of
from reliefgrid.llm.stored import join_counted, stored

ENTROPY_SHARE = 0.9
MAX_PASSES = 4.0
ROUNDS, LEVELS = 6, 6  # 36 bisections
BLOCK_ROWS = 5_000
SEED = "mix-1"


def sources_of(tokens: DataFrame) -> tuple[DataFrame, int]:
    """source, docs, tokens, share of each source, and the number of all tokens."""
    totals = stored(tokens.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "mixing-sources")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    return totals.withColumn("share", F.when(F.lit(whole > 0), F.col("tokens") / F.lit(float(whole))).otherwise(0.0)), whole


def at_exponents(sources: DataFrame, low: float, high: float) -> dict[float, tuple[float, float, float]]:
    """For each exponent that six bisections of [low, high] can visit: entropy, largest and smallest weight over share."""
    steps = 1 << LEVELS
    exponents = [low + (high - low) * k / steps for k in range(1, steps)]
    powered = sources.where("share > 0").select(
        "share", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a")) for k, a in enumerate(exponents)]))
    )
    term, ratio = F.pow("share", "a"), F.pow("share", F.col("a") - 1)
    rows = powered.groupBy("k").agg(
        F.sum(term).alias("z"), F.sum(term * F.col("a") * F.log("share")).alias("t"),
        F.max(ratio).alias("most"), F.min(ratio).alias("least"),
    ).collect()  # 63 rows
    return {exponents[r["k"]]: (math.log(r["z"]) - r["t"] / r["z"], r["most"] / r["z"], r["least"] / r["z"]) for r in rows}


def mixing_weights(
    sources: DataFrame, budget: float | None, entropy_share: float | None = ENTROPY_SHARE, max_passes: float | None = MAX_PASSES
) -> tuple[DataFrame, float]:
    """The sources with their weight, and the exponent.

    The exponent is the smallest in [0, 1], so the mix the most even, at which neither the entropy passes ``entropy_share`` of the
    largest possible nor a source is passed over more than ``max_passes`` times; 1 where no exponent meets both. ``budget``: tokens
    to give out, over all tokens; None: the least that passes over every source once.
    """
    count = sources.where("share > 0").count()
    low, high = 0.0, 1.0
    for _ in range(ROUNDS if count > 1 else 0):
        found = at_exponents(sources, low, high)
        for _ in range(LEVELS):
            middle = (low + high) / 2
            entropy, most, least = found[min(found, key=lambda a, m=middle: abs(a - m))]
            flat = entropy_share is not None and entropy > entropy_share * math.log(count)
            flat |= max_passes is not None and (most / least if budget is None else budget * most) > max_passes
            low, high = (middle, high) if flat else (low, middle)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(high))).otherwise(0.0)
    whole = sources.agg(F.sum(power)).first()[0] or 1.0
    return sources.withColumn("weight", power / F.lit(whole)), high


def drawn(tokens: DataFrame, weighted: DataFrame, budget_tokens: float, seed: str = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """row, passes of every document: whole passes of its source, and one more for documents of the part. ``tokens``: row, doc_id, source, n_tokens."""
    shares = weighted.select(
        F.col("source").alias("of"), F.col("tokens").alias("all_tokens"),
        F.greatest(F.lit(1), F.ceil(F.col("docs") / block_rows)).cast("long").alias("blocks"),
        F.floor(F.col("weight") * budget_tokens).cast("long").alias("budget"),
    ).select(
        "of", "blocks", F.when(F.col("all_tokens") > 0, F.floor(F.col("budget") / F.col("all_tokens"))).otherwise(1).cast("long").alias("whole"),
        F.when(F.col("all_tokens") > 0, F.col("budget") % F.col("all_tokens")).otherwise(0).cast("long").alias("part"),
    )
    rows = shares.count()
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = tokens.withColumn("key", key).withColumn("of", F.coalesce("source", F.lit("\0")))
    placed = join_counted(docs, shares.withColumn("of", F.coalesce("of", F.lit("\0"))), ["of"], "inner", rows, F.col("row"))
    placed = placed.withColumn("block", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.col("blocks")))
    order = F.md5(F.concat(F.lit(f"{seed}:block:"), F.col("block").cast("string")))
    blocks = placed.groupBy("of", "block").agg(
        F.sum("n_tokens").alias("block_tokens"), F.first("part").alias("block_part")
    ).withColumn("order", order)
    before = W.partitionBy("of").orderBy("order", "block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("begins", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)))
    cut = stored(starts.where((F.col("begins") < F.col("block_part")) & (F.col("block_part") > 0)).select("of", "block", "begins", "block_tokens"), "blocks")
    reached = join_counted(placed, cut, ["of", "block"], "left", cut.count(), F.col("row"))
    whole_block = F.col("begins") + F.col("block_tokens") <= F.col("part")
    clear = reached.where(F.col("begins").isNull() | whole_block).select(
        "row", (F.col("whole") + F.col("begins").isNotNull().cast("long")).alias("passes")
    )
    inside = W.partitionBy("of", "block").orderBy("key", "row").rowsBetween(W.unboundedPreceding, -1)
    edge = reached.where(F.col("begins").isNotNull() & ~whole_block)
    edge = edge.withColumn("at", F.col("begins") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).select(
        "row", (F.col("whole") + (F.col("at") < F.col("part")).cast("long")).alias("passes")
    )
    return clear.unionByName(edge)


def mixture(
    docs: DataFrame, budget: float | None = 1.0, entropy_share: float | None = ENTROPY_SHARE, max_passes: float | None = MAX_PASSES,
    seed: str = SEED, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row for each document: doc_id, source, n_tokens (words), weight, exponent, passes (0: left out), and key, to find its row again.

    ``budget``: tokens to give out, over all tokens; None: the least with which every document is in at least one whole pass.
    """
    source = docs["source"].cast("string")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    tokens = stored(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), source.alias("source"), F.size(words_of(text)).cast("long").alias("n_tokens"),
        F.xxhash64(source, text).alias("key"), F.monotonically_increasing_id().alias("row"),
    ), "mixing-tokens")
    sources, total = sources_of(tokens)
    weighted, exponent = mixing_weights(sources, budget, entropy_share, max_passes)
    if budget is None:
        least = weighted.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
        budget_tokens = least * (1 + 1e-9) + 1.0  # a little more, so that rounding down leaves no document out
    else:
        budget_tokens = budget * total
    weighted = stored(weighted, "mixing-weights")
    passes = drawn(tokens.drop("key"), weighted, budget_tokens, seed, block_rows)
    # weights go by source name; null has no equal, so it is named here
    named = weighted.select(F.coalesce("source", F.lit("\0")).alias("of"), "weight")
    rows = tokens.withColumn("of", F.coalesce("source", F.lit("\0")))
    rows = join_counted(rows, named, ["of"], "inner", weighted.count(), F.col("row")).drop("of")
    return rows.withColumn("exponent", F.lit(exponent)).join(passes, "row").drop("row")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix in all their columns, each as often as it is passed over."""
    passes = mixture(docs, **settings).where("passes > 0").groupBy(F.col("doc_id").alias("id"), F.col("key").alias("vkey")).agg(
        F.max("passes").alias("passes")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    key = F.xxhash64(F.col("d.source").cast("string"), F.coalesce(F.col("d.text").cast("string"), F.lit("")))
    joined = rows.withColumn("key", key).join(
        passes, (F.col("key") == F.col("vkey")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("id"))
    )
    again = joined.select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))).alias("nth"))
    return again.select(*[F.col("d").getField(c).alias(c) for c in docs.columns])
