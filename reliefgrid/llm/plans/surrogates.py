"""op10: all documents with surrogates for personal data and secrets."""

from reliefgrid.llm.plans import table
from reliefgrid.llm.surrogates import with_surrogates

NAME = "op10_pii_surrogates"
SQL = None


def plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs, count_column="n_entities")
