"""Connected components of a table of links, by contraction: links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.stored import stored


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) of every id that has a link. ``links``: a, b.

    Each round every id points to its smallest neighbour, pointers are followed to their roots, and links are carried over to the
    roots; what is left joins different roots. Rounds are few, as the number of roots at least halves.
    """
    left = stored(links.select("a", "b").where("a != b").distinct(), "links")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "roots")
        while True:
            above = roots.select(F.col("id").alias("label"), F.col("label").alias("root"))
            further = stored(roots.join(above, "label").select("id", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved")), "roots")
            roots = further.select("id", "label")
            if further.where("moved").isEmpty():
                break
        if labels is None:
            labels = roots
        else:
            above = roots.select(F.col("id").alias("label"), F.col("label").alias("root"))
            labels = stored(labels.join(above, "label", "left").select("id", F.coalesce("root", "label").alias("label")), "labels")
        of_a = roots.select(F.col("id").alias("a"), F.col("label").alias("ra"))
        of_b = roots.select(F.col("id").alias("b"), F.col("label").alias("rb"))
        left = stored(
            left.join(of_a, "a").join(of_b, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(),
            "links",
        )
    return links.select(F.col("a").alias("id"), F.col("b").alias("label")).limit(0) if labels is None else labels
