"""op4: token counts of all documents by the word vocabulary."""

import public_tokenizers

from reliefgrid.llm.bpe_count import count_tokens
from reliefgrid.llm.plans import table

NAME = "op4_token_counts"
SQL = None


def plan(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
