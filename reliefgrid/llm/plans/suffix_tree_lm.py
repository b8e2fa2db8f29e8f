"""op9: scores of all documents by a probabilistic suffix tree of four fifths of them."""

from reliefgrid.llm.plans import table
from reliefgrid.llm.suffix_tree_lm import score_documents

NAME = "op9_lm_scores"
SQL = None


def plan(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))
