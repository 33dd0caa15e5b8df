"""SQL that gives the same rows as the queries of this subpackage, where SQL can."""

# What stands for an absent name or address, stated as patterns of its own.
_ABSENT = "[-?.]+|n/?a|nil|none|null|nan|unknown|undefined|anonymous|tbd|not (set|available)|nobody|empty|missing"
_NO_NAME = _ABSENT + "|no ?name|no (author|user)|your name"
_NO_EMAIL = _ABSENT + "|no ?e-?mail|no (address|mail)|none@none([.]invalid)?|nobody@(invalid|nowhere)|unknown@unknown|you@example[.]com"

_P1 = r"""
WITH RECURSIVE
ids AS (SELECT DISTINCT id FROM people WHERE id IS NOT NULL),
agreed AS (SELECT id_a AS x, id_b AS y FROM person_links
  WHERE lower(trim(verdict)) = 'same' AND id_a IN (SELECT id FROM ids) AND id_b IN (SELECT id FROM ids) AND id_a <> id_b),
em AS (SELECT DISTINCT id, k FROM (SELECT id, lower(trim(e)) AS k FROM (SELECT id, unnest(emails) AS e FROM people))
  WHERE k <> '' AND k NOT IN (SELECT lower(entry) FROM filter_lists WHERE list_name IN ('emails', 'popular_emails'))),
nm AS (SELECT DISTINCT id, k, CASE WHEN pop THEN repo ELSE '' END AS repo FROM (
  SELECT id, k, repo, k IN (SELECT lower(entry) FROM filter_lists WHERE list_name = 'popular_names') AS pop FROM (
    SELECT id, lower(trim(regexp_replace(n.name, '[\s\p{Z}]+', ' ', 'g'))) AS k, coalesce(n.repo, '') AS repo
    FROM (SELECT id, unnest(names) AS n FROM people))
  WHERE k <> '') WHERE NOT pop OR repo <> ''),
a AS (
  SELECT id, min(id) OVER (PARTITION BY k) AS r FROM em
  UNION SELECT id, min(id) OVER (PARTITION BY k, repo) FROM nm
  UNION SELECT x, y FROM agreed),
e AS (SELECT id AS x, r AS y FROM a WHERE id <> r UNION SELECT r, id FROM a WHERE id <> r),
cc(id, lab) USING KEY (id) AS (
  SELECT id, id FROM ids
  UNION
  SELECT e.x, min(l.lab) FROM cc l JOIN e ON e.y = l.id JOIN recurring.cc r ON r.id = e.x
  WHERE l.lab < r.lab GROUP BY e.x, r.lab)
SELECT id, lab AS group_id FROM (SELECT id, lab, count(*) OVER (PARTITION BY lab) AS n FROM cc) WHERE n > 1
"""

_P7 = rf"""
WITH bare AS (
  SELECT p.*, o.trust,
    lower(regexp_replace(regexp_replace(primary_name, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g'), '^[<(\[{{]\s*(.*?)\s*[>)\]}}]$', '\1')) AS bn,
    lower(regexp_replace(regexp_replace(primary_email, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g'), '^[<(\[{{]\s*(.*?)\s*[>)\]}}]$', '\1')) AS be
  FROM people p LEFT JOIN (SELECT origin, max(trust) AS trust FROM record_origins WHERE origin IS NOT NULL GROUP BY origin) o ON p.record_origin = o.origin
  WHERE external_id_provider IS NOT NULL AND external_id IS NOT NULL),
n AS (SELECT * FROM bare WHERE bn <> '' AND NOT regexp_full_match(bn, '{_NO_NAME}')
  QUALIFY row_number() OVER (PARTITION BY external_id_provider, external_id ORDER BY trust DESC NULLS LAST, updated_at DESC NULLS LAST, id) = 1),
m AS (SELECT * FROM bare WHERE be <> '' AND NOT regexp_full_match(be, '{_NO_EMAIL}')
  QUALIFY row_number() OVER (PARTITION BY external_id_provider, external_id ORDER BY trust DESC NULLS LAST, updated_at DESC NULLS LAST, id) = 1),
g AS (SELECT external_id_provider, external_id FROM bare GROUP BY ALL HAVING count(*) >= 2)
"""

_P5 = """
WITH u AS (
  SELECT 'commit_author_name' AS field, row_ix, unnest(string_split(commit_author_name, ' ')) AS term FROM commits
  UNION ALL SELECT 'commit_author_email', row_ix, commit_author_email FROM commits),
s AS (SELECT field, term, count(*) AS n_occurrences, count(DISTINCT row_ix) AS n_records FROM u WHERE term <> '' GROUP BY ALL),
m AS (SELECT *, CASE WHEN n_records >= 0.01 * (SELECT count(*) FROM commits) THEN 'common' WHEN n_records <= 2 THEN 'rare' END AS mark FROM s)
"""

#: Every stretch of 200 characters of every text, grouped by two hashes; runs of those that stand in two documents.
_P10 = """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL),
w AS MATERIALIZED (SELECT doc_id, p, hash(s) AS a, hash(s || 'x') AS b FROM (
  SELECT doc_id, p, substr(text, p + 1, 200) AS s FROM (SELECT doc_id, text, unnest(range(n - 199)) AS p FROM d))),
k AS (SELECT a, b FROM w GROUP BY a, b HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT doc_id, p FROM w JOIN k USING (a, b)),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM s)),
r AS (SELECT doc_id, min(p) AS start_pos, max(p) + 200 AS end_pos FROM g GROUP BY doc_id, run)
"""

SQL: dict[str, str] = {
    "p10_found": _P10 + "SELECT * FROM r",
    "p10_coverage": _P10
    + """SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n_runs, 0) AS n_runs, coalesce(n_shared, 0)::BIGINT AS n_shared
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n_runs, sum(end_pos - start_pos) AS n_shared FROM r GROUP BY 1) USING (doc_id)""",
    "p1_found": _P1,
    "p7_found": _P7
    + "SELECT external_id_provider, external_id, n.id AS name_id, m.id AS email_id FROM g LEFT JOIN n USING (external_id_provider, external_id) LEFT JOIN m USING (external_id_provider, external_id)",
    "p7_records": _P7
    + "SELECT external_id_provider, external_id, n.id AS name_id, m.id AS email_id, n.primary_name, m.primary_email FROM g LEFT JOIN n USING (external_id_provider, external_id) LEFT JOIN m USING (external_id_provider, external_id)",
    "p5_found": _P5 + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p5_terms": _P5 + "SELECT * FROM m",
}
