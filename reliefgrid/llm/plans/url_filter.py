"""op2: every page's url against the rules and the block list."""

from reliefgrid.llm import url_filter as f
from reliefgrid.llm.plans import table

NAME = "op2_url_filter"


def plan(spark, sf_dir):
    return f.judge_urls(table(spark, sf_dir, "pages")).drop("listed")


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


SQL = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{f.UPPER}', '{f.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*(/[^?#]*)', 1, 's') AS path, row_number() OVER () AS r
  FROM pages
), rules(h, p, v) AS (VALUES {_values(f.RULES)}), blocked(h, p) AS (VALUES {_values(f.BLOCKED)}
), best AS (
  SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
), listed AS (SELECT DISTINCT r FROM u JOIN blocked ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v WHEN listed.r IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN best USING (r) LEFT JOIN listed ON u.r = listed.r
"""
