"""op12: whitened embeddings, 32 components."""

from reliefgrid.llm.plans import table
from reliefgrid.llm.qd_whitening import whitening

NAME = "op12_whitening"
SQL = None


def plan(spark, sf_dir):
    return whitening(table(spark, sf_dir, "embeddings"))
