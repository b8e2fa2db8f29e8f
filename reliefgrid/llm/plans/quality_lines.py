"""op1: quality rules with cross-document line frequency, over all documents."""

from reliefgrid.llm import quality_lines as rules
from reliefgrid.llm.plans import table

NAME = "op1_quality_rules"
COLUMNS = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed"
)


def plan(spark, sf_dir):
    return rules.quality_verdicts(table(spark, sf_dir, "documents")).select(*COLUMNS)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), win AS (
  SELECT r, i, array_to_string(w[i : i + {rules.WINDOW - 1}], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - {rules.WINDOW - 2})) AS i FROM w)
), rep AS (
  SELECT r, i, lag(i, 1, -{rules.WINDOW}) OVER (PARTITION BY r ORDER BY i) AS before
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1
), repeats AS (SELECT r, sum(least({rules.WINDOW}, i - before)) AS n_repeat_words FROM rep GROUP BY r
), l AS (
  SELECT r, host, text, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    regexp_replace(regexp_replace(regexp_replace(translate(line, '{rules.UPPER}', '{rules.LOWER}'), '[0-9]+', '0', 'g'),
      '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS h
  FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r
), hosts AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host
), common AS (
  SELECT host, h FROM l JOIN hosts USING (host) GROUP BY host, h, host_docs
  HAVING count(DISTINCT text) > {rules.MIN_DOCS} AND count(DISTINCT text) > {rules.MAX_HOST_SHARE} * host_docs
), gone AS (SELECT r, sum(n) AS n_removed FROM l JOIN common USING (host, h) GROUP BY r
), f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r)
), v AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f
)
SELECT *, NOT base_failed AND NOT n_words - n_removed < {rules.MIN_LEFT_SHARE} * n_words AS kept FROM v
"""
