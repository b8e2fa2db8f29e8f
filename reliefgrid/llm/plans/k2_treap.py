"""op11: the twenty best documents for every benchmark item."""

from reliefgrid.llm.k2_treap import ranked_documents
from reliefgrid.llm.plans import table

NAME = "op11_ranked_search"


def plan(spark, sf_dir):
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH term AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), size AS (SELECT r, count(*)::BIGINT AS n FROM term GROUP BY r
), corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM size
), tf AS (SELECT r, doc_id, t, count(*)::BIGINT AS tf FROM term GROUP BY r, doc_id, t
), w AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY t, docs
), asked AS (
  SELECT q, item_id, t, count(*)::BIGINT AS times
  FROM (SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark))
  GROUP BY q, item_id, t
), s AS (
  SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN w USING (t) JOIN size USING (r), corpus WHERE doc_id IS NOT NULL GROUP BY q, item_id, r, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
