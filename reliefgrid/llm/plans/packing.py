"""op3: all documents packed into sequences of 2048 tokens."""

import public_tokenizers

from reliefgrid.llm.packing import pack
from reliefgrid.llm.plans import table

NAME = "op3_pack_sequences"
SQL = None


def plan(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
