"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight, source_size * 3 AS lim FROM s),
l AS (
  SELECT *, lim / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lev FROM w),
v AS (SELECT *, max(CASE WHEN lev <= ratio THEN lev END) OVER () AS level FROM l),
t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN lim::DOUBLE ELSE weight * level END AS target FROM v),
r AS (
  SELECT doc_id, d.source AS source, size, source_size, target, row_number() OVER w AS i, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW w AS (PARTITION BY d.source ORDER BY size DESC, k)),
n AS (SELECT *, (SELECT count(*) FROM range(1, 7) x(j) WHERE b * (1 << j) >= source_size * ((1 << j) - 1)) AS tier FROM r),
s0 AS (
  SELECT source, source_size, target, CAST('0x' || substr(md5(concat('7:', coalesce('s' || source, 'n'))), 1, 4) AS BIGINT) / 65536.0::DOUBLE AS u,
    0::BIGINT AS n, 0::BIGINT AS words, 0::BIGINT AS given, 0.0::DOUBLE AS base,
    CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, greatest(0.0::DOUBLE, target / source_size)) ELSE 0.0::DOUBLE END AS rate FROM t)""" + "".join(f"""
, d{k} AS (
  SELECT n.source AS source, count(*) AS dn, sum(size)::BIGINT AS dwords,
    sum(least((floor(base + (i - s.n) * rate + u) - floor(base + (i - 1 - s.n) * rate + u))::BIGINT, 3) * size)::BIGINT AS dgiven
  FROM n JOIN s{k} s ON n.source IS NOT DISTINCT FROM s.source WHERE tier = {k} GROUP BY n.source),
s{k + 1} AS (
  SELECT *, CASE WHEN source_size > words THEN least(3.0::DOUBLE, greatest(0.0::DOUBLE, (target - given) / (source_size - words))) ELSE 0.0::DOUBLE END AS rate
  FROM (SELECT s.source AS source, source_size, target, u, n + coalesce(dn, 0) AS n, words + coalesce(dwords, 0) AS words, given + coalesce(dgiven, 0) AS given, base + coalesce(dn, 0) * rate AS base
    FROM s{k} s LEFT JOIN d{k} ON s.source IS NOT DISTINCT FROM d{k}.source))""" for k in range(6)) + ", states AS (" + " UNION ALL ".join(f"SELECT source, n AS first, base, rate, u, {k} AS tier FROM s{k}" for k in range(7)) + """)
SELECT doc_id, size, source_size, target, least((floor(base + (i - first) * rate + u) - floor(base + (i - 1 - first) * rate + u))::BIGINT, 3) * size AS taken
FROM n JOIN states s ON n.source IS NOT DISTINCT FROM s.source AND n.tier = s.tier
"""


OP7 = "SELECT doc_id, lang, source, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3, "op7_sharding": OP7}
