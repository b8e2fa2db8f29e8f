"""op5: near-duplicate documents at a similarity of 0.85."""

from reliefgrid.llm.minmax_dedup import near_duplicates
from reliefgrid.llm.plans import table

NAME = "op5_near_duplicates"
MIN_PERCENT = 85
SQL = None


def plan(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), MIN_PERCENT)
