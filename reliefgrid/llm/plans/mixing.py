"""op6: all documents mixed by source, to nine tenths of the largest entropy, within as many tokens as there are."""

from pyspark.sql import functions as F

from reliefgrid.llm import mixing as m
from reliefgrid.llm.plans import table

NAME = "op6_mix_sources"


def plan(spark, sf_dir):
    return m.mixture(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), F.round("exponent", 9).alias("exponent"), "passes"
    )


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), s AS (
  SELECT source, count(*) AS docs, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens) / (SELECT sum(n_tokens) FROM d)::DOUBLE AS share
  FROM d GROUP BY source
), p AS (SELECT list(share) FILTER (share > 0) AS ps FROM s
), bisection AS (
  SELECT 0 AS n, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT n + 1, CASE WHEN flat THEN mid ELSE low END, CASE WHEN flat THEN high ELSE mid END
  FROM (
    SELECT n, low, high, mid,
      ln(z) - t / z > {m.ENTROPY_SHARE} * ln(len(ps)) OR most / z > {m.MAX_PASSES} AS flat
    FROM (
      SELECT n, low, high, (low + high) / 2 AS mid, ps, list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2))) AS z,
        list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2) * (low + high) / 2 * ln(x))) AS t,
        list_max(list_transform(ps, lambda x: pow(x, (low + high) / 2 - 1))) AS most
      FROM bisection, p
    )
  ) WHERE n < {m.ROUNDS * m.LEVELS}
), e AS (SELECT high AS exponent FROM bisection WHERE n = {m.ROUNDS * m.LEVELS}
), w AS (
  SELECT source, docs, tokens, exponent, pow(share, exponent) / sum(pow(share, exponent)) OVER () AS weight FROM s, e
), b AS (
  SELECT *, greatest(1, ceil(docs / {m.BLOCK_ROWS}))::BIGINT AS blocks, floor(budget / tokens)::BIGINT AS whole, budget % tokens AS part
  FROM (SELECT *, floor(weight * sum(tokens) OVER ()) AS budget FROM w)
), k AS (
  SELECT r, doc_id, d.source, n_tokens, b.* EXCLUDE (source), md5('{m.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), o AS (
  SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % blocks AS block FROM k
), run AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY md5('{m.SEED}:block:' || block::VARCHAR), block, key, r
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM o
)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, round(exponent, 9) AS exponent,
  whole + CASE WHEN begins < part THEN 1 ELSE 0 END::BIGINT AS passes
FROM run
"""
