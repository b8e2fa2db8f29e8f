"""op8: all documents without the 20-word sequences that also start earlier."""

from reliefgrid.llm.plans import table
from reliefgrid.llm.suffix_repeats import digests, without_repeats

NAME = "op8_substring_dedup"


def plan(spark, sf_dir):
    return digests(without_repeats(table(spark, sf_dir, "documents")))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), marked AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM marked
), word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
