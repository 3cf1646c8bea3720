"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

LINES = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
  k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  f AS (SELECT key, count(DISTINCT doc_id) >= 10 AND key <> '' AS gone FROM k GROUP BY key)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM k JOIN f USING (key) GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": LINES}
