"""SQL that DuckDB can run on the same tables, for the training-data queries that SQL expresses."""

from __future__ import annotations

P5_FOUND = r"""
WITH w AS (SELECT DISTINCT render_id, coalesce(site, '') AS site, text FROM build_pdf WHERE medium = 'web'),
total AS (SELECT site, count(DISTINCT render_id) AS site_rows FROM w GROUP BY site),
l AS (SELECT render_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM w WHERE text IS NOT NULL),
n AS (SELECT render_id, site, line_no, lower(trim(regexp_replace(line, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS k
      FROM l WHERE regexp_matches(line, '\p{L}')),
c AS (SELECT site, k, count(DISTINCT render_id) AS n_rows FROM n GROUP BY site, k),
bad AS (SELECT c.site, c.k FROM c JOIN total USING (site) WHERE n_rows >= 5 AND n_rows >= 0.03 * site_rows)
SELECT DISTINCT n.render_id, CAST(n.line_no AS BIGINT) AS line_no FROM n JOIN bad ON n.site = bad.site AND n.k = bad.k
"""

P5_BOILERPLATE = r"""
WITH w AS (SELECT render_id, coalesce(site, '') AS site, text, min(date_trunc('hour', rendered_at)) AS day FROM build_pdf WHERE medium = 'web' GROUP BY 1, 2, 3),
cluster AS (SELECT site, text, min(day) AS day FROM w GROUP BY site, text),
total AS (SELECT site, count(*) AS site_clusters FROM cluster GROUP BY site),
l AS (SELECT render_id, site, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM w WHERE text IS NOT NULL),
n AS (SELECT render_id, site, text, line_no, lower(trim(regexp_replace(line, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS k
      FROM l WHERE regexp_matches(line, '\p{L}')),
c AS (SELECT n.site, k, count(DISTINCT n.text) AS n_clusters, count(DISTINCT day) AS n_dates FROM n JOIN cluster ON cluster.site = n.site AND cluster.text = n.text GROUP BY n.site, k),
bad AS (SELECT c.site, c.k FROM c JOIN total USING (site) WHERE n_clusters >= 5 AND n_dates >= 2 AND n_clusters >= 0.03 * site_clusters)
SELECT DISTINCT n.render_id, CAST(n.line_no AS BIGINT) AS line_no FROM n JOIN bad ON n.site = bad.site AND n.k = bad.k
"""

_FOUND = P5_FOUND.strip().removesuffix("\n")
P5_CLEANED = f"""
WITH gone AS ({_FOUND}), one AS (SELECT DISTINCT render_id, site, text FROM build_pdf WHERE medium = 'web'),
cut AS (SELECT render_id, list(line_no) AS n FROM gone GROUP BY render_id)
SELECT one.render_id, one.site, list_aggregate(list_filter(string_split(text, chr(10)), lambda x, i: NOT coalesce(list_contains(n, i), false)), 'string_agg', chr(10)) AS joined,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(joined, '') END AS clean_text, CAST(coalesce(len(n), 0) AS INTEGER) AS n_removed FROM one LEFT JOIN cut ON cut.render_id = one.render_id
"""
P5_CLEANED = f"SELECT render_id, site, clean_text, n_removed FROM ({P5_CLEANED})"
