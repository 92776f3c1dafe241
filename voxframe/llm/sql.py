"""DuckDB statements for the pN_ queries that SQL can express on whole tables.

The others (p1, p4, p5, p6 near rows, p7, p8, p9) are tested against brute force, a public tokenizer or round trips in
``tests/llm``.
"""

from __future__ import annotations

_DROP = r"[^\p{L}\p{M}\p{N}]+"

P3 = rf"""
WITH r AS (SELECT DISTINCT response_key, question_id, regexp_replace(lower(response_text), '{_DROP}', '', 'g') AS s
           FROM responses WHERE response_text IS NOT NULL),
w AS (SELECT DISTINCT dataset_id, row_index, cells FROM raw_rows WHERE cells IS NOT NULL),
c AS (SELECT dataset_id, row_index, k, regexp_replace(lower(json_extract_string(cells, '$."' || k || '"')), '{_DROP}', '', 'g') AS v
      FROM (SELECT *, unnest(json_keys(cells)) AS k FROM w)),
f AS (SELECT dataset_id, row_index, string_agg(k || '=' || v, '|' ORDER BY k) AS s FROM c WHERE v <> '' GROUP BY ALL)
SELECT 'responses' AS record_kind, min(response_key) AS first_key, CAST(count(*) AS BIGINT) AS copies
FROM r WHERE s <> '' GROUP BY question_id, s HAVING count(*) >= 2
UNION ALL
SELECT 'raw_rows', dataset_id || ':' || min(row_index), CAST(count(*) AS BIGINT) FROM f GROUP BY dataset_id, s HAVING count(*) >= 2
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3}
