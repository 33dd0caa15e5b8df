"""SQL that gives the same rows as the core queries, where SQL can. Nothing here comes from the code under test."""

_BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _plain(x: str) -> str:
    return f"strip_accents({x})"


def _tidy(x: str, low: bool = True) -> str:
    x = f"lower({x})" if low else x
    return f"trim(regexp_replace({x}, '{_BLANK}', ' ', 'g'))"


def _clean(x: str) -> str:
    return _tidy(_plain(x))


_LISTS = f"fl AS MATERIALIZED (SELECT DISTINCT list_name, {_clean('entry')} AS entry FROM filter_lists)"


def _in(x: str, name: str) -> str:
    return f"({x} IN (SELECT entry FROM fl WHERE list_name = '{name}'))"


_DOM = "coalesce(string_split(email, '@')[2], '')"
_LAST = "string_split(email, '@')[-1]"
_MULTI = "(length(email) - length(replace(email, '@', '')) > 1)"


def _ip(x: str) -> str:
    full = "([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    return f"(regexp_matches({x}, '[0-9]+([.][0-9]+){{3}}$') OR contains({x}, '::') OR regexp_matches({x}, '{full}') OR regexp_matches({x}, 'fe80:%[0-9a-zA-Z]+'))"


_IGNORED_MAIL = (
    f"(NOT contains(email, '@') OR {_in('email', 'emails')} OR {_MULTI} OR {_in(_DOM, 'domains')} OR "
    f"{_in(f'string_split({_DOM}, chr(46))[-1]', 'top_level_domains')} OR NOT contains({_DOM}, '.') OR {_ip(_DOM)})"
)
_IGNORED_NAME = _in("lower(name)", "names")

_GROUP = """src AS MATERIALIZED (
  SELECT coalesce(repository_id, '') AS repo, coalesce(commit_author_name, '') AS name, coalesce(commit_author_email, '') AS email,
    coalesce(max(commit_hash), '') AS hash, max(commit_author_when) AS ts, min(row_ix) AS row_ix
  FROM commits GROUP BY 1, 2, 3)"""

_SIG = f"""{_LISTS}, {_GROUP},
sig AS MATERIALIZED (SELECT * FROM (SELECT repo, {_clean('name')} AS name, {_clean('email')} AS email, hash, ts, row_ix FROM src)
  WHERE repo <> '' AND name <> '' AND email <> '' AND hash <> '' AND ts IS NOT NULL),
people_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_ix) AS id, name, CASE WHEN {_in('name', 'popular_names')} THEN repo ELSE '' END AS repo,
  email, hash, repo AS sample_repo, ts FROM sig WHERE NOT {_IGNORED_MAIL} AND NOT {_IGNORED_NAME}),
pk AS MATERIALIZED (SELECT *, CASE WHEN repo = '' THEN name ELSE concat('{{', name, ', ', repo, '}}') END AS name_key FROM people_)"""

_MAILS = f"SELECT id, email AS k FROM pk WHERE NOT {_in('email', 'popular_emails')}"
_NAMES = f"SELECT id, name_key AS k FROM pk WHERE NOT {_in('name_key', 'popular_names')}"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p for p in parts if p) + "\n"


def _components(nodes: str, *keys: str, out: str = "lab") -> str:
    links = "\n  UNION ".join(f"SELECT id, min(id) OVER (PARTITION BY k) AS r FROM ({k})" for k in keys)
    return f"""a_{out} AS ({links}),
e_{out} AS (SELECT id AS x, r AS y FROM a_{out} WHERE id <> r UNION SELECT r, id FROM a_{out} WHERE id <> r),
c_{out}(id, lab) USING KEY (id) AS (
  SELECT id, id FROM {nodes}
  UNION
  SELECT e.x, min(l.lab) FROM c_{out} l JOIN e_{out} e ON e.y = l.id JOIN recurring.c_{out} r ON r.id = e.x WHERE l.lab < r.lab GROUP BY e.x, r.lab),
{out} AS MATERIALIZED (SELECT id, lab AS component FROM c_{out})"""


_ALL = _components("pk", _MAILS, _NAMES)
_BY_MAIL = _components("pk", _MAILS)
#: The identity limit replayed: of every component taken without it, one person after another, all components side by side.
#: A name that is not its key's first links to that first while both sides have fewer addresses and names than the limit.
#: Row -1 counts the steps.


def _limited(limit: int) -> str:
    return f"""{_components("pk", _MAILS, out="bymail")},
{_components("pk", _MAILS, _NAMES, out="whole")},
big AS MATERIALIZED (SELECT component FROM pk JOIN whole USING (id) GROUP BY 1 HAVING count(DISTINCT email) + count(DISTINCT name_key) >= {limit}),
node AS MATERIALIZED (SELECT pk.id, email, name_key, w.component AS whole, b.component AS bymail FROM pk JOIN whole w USING (id) JOIN big USING (component) JOIN bymail b USING (id)),
event AS MATERIALIZED (SELECT id, anchor, row_number() OVER (PARTITION BY whole ORDER BY id) AS step FROM (
  SELECT id, whole, min(id) OVER (PARTITION BY name_key) AS anchor FROM node WHERE NOT {_in('name_key', 'popular_names')}) WHERE id <> anchor),
st(id, lab) USING KEY (id) AS (
  SELECT id, bymail FROM node UNION SELECT -1, 0
  UNION
  SELECT * FROM (
    WITH now AS (SELECT x.lab AS lx, y.lab AS ly FROM event
        JOIN recurring.st t ON t.id = -1 AND event.step = t.lab + 1
        JOIN recurring.st x ON x.id = event.id JOIN recurring.st y ON y.id = event.anchor WHERE x.lab <> y.lab),
      side AS (SELECT s.lab, count(DISTINCT email) + count(DISTINCT name_key) AS n FROM recurring.st s JOIN node ON node.id = s.id
        WHERE s.lab IN (SELECT lx FROM now UNION SELECT ly FROM now) GROUP BY 1),
      merge AS (SELECT lx, ly FROM now JOIN side a ON a.lab = lx JOIN side b ON b.lab = ly WHERE a.n < {limit} AND b.n < {limit})
    SELECT s.id, least(lx, ly) FROM recurring.st s JOIN merge ON s.lab = greatest(lx, ly) WHERE s.id > 0
    UNION ALL SELECT -1, t.lab + 1 FROM recurring.st t WHERE t.id = -1 AND t.lab < (SELECT max(step) FROM event))),
lab AS MATERIALIZED (SELECT id, component, false AS replayed FROM whole WHERE component NOT IN (SELECT component FROM big)
  UNION ALL SELECT id, lab, true FROM st WHERE id > 0)"""


_CUT = "TIMESTAMPTZ '2019-08-01 00:00:00+00'"


def _freq(column: str) -> str:
    return f"SELECT {column} AS value, count(*) FILTER (WHERE ts > {_CUT}) AS recent, count(*) AS total FROM sig GROUP BY 1"


def _primary(column: str) -> str:
    key = "name_key" if column == "name" else column
    return f"""(SELECT id, CASE WHEN n > 0 THEN value ELSE '' END AS value FROM (
  SELECT id, value, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, k, value) AS rn FROM (
    SELECT id, value, k, CASE WHEN sum(recent) OVER (PARTITION BY id) >= 5 THEN recent ELSE total END AS n FROM (
      SELECT DISTINCT component AS id, {column} AS value, {key} AS k FROM pk JOIN lab USING (id)) JOIN ({_freq(column)}) USING (value))) WHERE rn = 1)"""


_MERGED = """m AS (SELECT component AS id, array_to_string(list_sort(list_distinct(list(name_key))), '|') AS names,
  array_to_string(list_sort(list_distinct(list(email))), '|') AS emails, count(DISTINCT id) AS n_persons FROM pk JOIN lab USING (id) GROUP BY 1)"""
_ALIASES = """al AS MATERIALIZED (SELECT DISTINCT component AS id, email, '' AS name, '' AS repo FROM pk JOIN lab USING (id)
  UNION ALL SELECT DISTINCT component, '', name, repo FROM pk JOIN lab USING (id))"""
_IDENTITIES = f"""idn AS (SELECT n.id, n.value AS primary_name, m.value AS primary_email, '' AS external_id_provider, '' AS external_id
  FROM {_primary('name')} n JOIN {_primary('email')} m ON n.id = m.id)"""
_ACCOUNTS = f"""acc AS MATERIALIZED (SELECT email, min(u) AS u FROM (SELECT {_clean('e')} AS email, external_id AS u FROM (
  SELECT unnest(emails) AS e, external_id FROM people WHERE external_id_provider = 'githarbor')) WHERE email <> '' AND u IS NOT NULL GROUP BY 1)"""
_SCORES = """t AS (SELECT u AS truth_id, email AS entity FROM acc),
f AS (SELECT DISTINCT component AS found_id, email AS entity FROM pk JOIN lab USING (id)),
c AS (SELECT truth_id, found_id, count(*) AS common FROM t JOIN f USING (entity) GROUP BY 1, 2),
s AS (SELECT truth_id, found_id, common, truth_size, found_size, common / found_size AS precision, common / truth_size AS recall FROM c
  JOIN (SELECT truth_id, count(*) AS truth_size FROM t GROUP BY 1) USING (truth_id) JOIN (SELECT found_id, count(*) AS found_size FROM f GROUP BY 1) USING (found_id)),
sc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM s)"""
_OWN = """rows_ AS MATERIALIZED (SELECT id, email, unnest([concat('address ', email), concat('name ', name_key)]) AS entity FROM pk),
t AS (SELECT DISTINCT u AS truth_id, entity FROM rows_ JOIN acc USING (email)),
f AS (SELECT DISTINCT component AS found_id, entity FROM rows_ JOIN lab USING (id)),
""" + _SCORES[_SCORES.index("c AS (") :]
_COUNTS = f"""k AS (
  SELECT 'clean names' AS key, count(*) FILTER (WHERE {_tidy('p')} <> p) AS value FROM (SELECT {_plain('name')} AS p FROM src)
  UNION ALL SELECT 'clean emails', count(*) FILTER (WHERE {_tidy('p')} <> p) FROM (SELECT {_plain('email')} AS p FROM src)
  UNION ALL SELECT 'people found', count(*) FROM sig
  UNION ALL SELECT 'ignored emails', count(*) FROM sig WHERE {_IGNORED_MAIL}
  UNION ALL SELECT 'ignored names', count(*) FROM sig WHERE NOT {_IGNORED_MAIL} AND {_IGNORED_NAME}
  UNION ALL SELECT 'popular names', count(*) FROM sig WHERE {_in('name', 'popular_names')}
  UNION ALL SELECT 'people after filtering', count(*) FROM pk
  UNION ALL SELECT 'popular emails found', count(*) FROM pk WHERE {_in('email', 'popular_emails')}
  UNION ALL SELECT 'popular names found', count(*) FROM pk WHERE {_in('name_key', 'popular_names')}
  UNION ALL SELECT 'people matched by email', count(DISTINCT k) FROM ({_MAILS})
  UNION ALL SELECT 'people matched by name', count(DISTINCT k) FROM ({_NAMES})
  UNION ALL SELECT 'people after reduce', count(DISTINCT component) FROM lab
  UNION ALL SELECT 'graph edges', sum(n) FROM (SELECT count(*) - count(DISTINCT k) AS n FROM ({_MAILS}) UNION ALL SELECT count(*) - count(DISTINCT k) FROM ({_NAMES}))
  UNION ALL SELECT 'connected component size mean', avg(n) FROM (SELECT count(*) AS n FROM lab GROUP BY component)
  UNION ALL SELECT 'connected component size std', stddev_samp(n) FROM (SELECT count(*) AS n FROM lab GROUP BY component)
  UNION ALL SELECT 'connected component size max', max(n) FROM (SELECT count(*) AS n FROM lab GROUP BY component)
  UNION ALL SELECT 'external API emails found', count(DISTINCT email) FROM pk WHERE email IN (SELECT email FROM acc)
  UNION ALL SELECT 'external API components', count(DISTINCT u) FROM pk JOIN acc USING (email)
  UNION ALL SELECT 'external API emails not found', count(DISTINCT email) FROM pk WHERE email NOT IN (SELECT email FROM acc))"""
_FIRST = "fs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(id)) - 1 AS ix, name, email FROM pk GROUP BY name, email)"


def _scalar(column: str, out: str, f: str) -> str:
    return f"SELECT value, {f} AS {out} FROM (SELECT DISTINCT {column} AS value FROM commits WHERE {column} IS NOT NULL)"


def _mail(flag: str) -> str:
    mails = f"SELECT DISTINCT {_clean('commit_author_email')} AS email FROM commits WHERE commit_author_email IS NOT NULL"
    return _with(_LISTS) + f"SELECT email, {flag} AS flag FROM ({mails})"


def _name(flag: str) -> str:
    names = f"SELECT DISTINCT {_clean('commit_author_name')} AS name FROM commits WHERE commit_author_name IS NOT NULL"
    return _with(_LISTS) + f"SELECT name, {flag} AS flag FROM ({names})"


_N, _M = "commit_author_name", "commit_author_email"
_SHOW = "concat('[', {}, ' ', {}, ' ', {}, ' ', {}, ' ', coalesce(strftime(timezone('UTC', ts), '%Y-%m-%dT%H:%M:%SZ'), '<no time>'), ']')".format(
    *[f"CASE WHEN {c} = '' THEN '<no {c}>' ELSE {c} END" for c in ("repo", "name", "email", "hash")]
)

_FIELD = '"(?:[^"]|"")*"|[^",]*'
_LINES = rf"""
WITH f AS (
  SELECT line_id, raw_line, CASE WHEN raw_line IS NULL OR raw_line = '' THEN 'columns'
      WHEN NOT regexp_full_match(raw_line, '(?:{_FIELD})(?:,(?:{_FIELD}))*') THEN 'quoting' END AS broken,
    list_transform(regexp_extract_all(',' || raw_line, ',({_FIELD})', 1),
      lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS fs
  FROM commit_lines),
t AS (SELECT *, list_transform(fs, lambda x: trim(x, ' ')) AS ts, regexp_extract(trim(fs[5], ' '), '^([0-9]{{4}})-([0-9]{{2}}-[0-9]{{2}})T([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})(?:[.]([0-9]+))?(Z|[+-][0-9]{{2}}:[0-9]{{2}})$',
    ['y', 'd', 'c', 'f', 'z']) AS w FROM f),
r AS (SELECT *, try_cast(concat(w.y, '-', w.d, ' ', w.c) AS TIMESTAMP) AS base, CASE
    WHEN broken IS NOT NULL THEN broken WHEN len(fs) <> 5 THEN 'columns'
    WHEN len(list_filter(ts[1:3], lambda x: x = '' OR length(x) > 50 OR regexp_matches(x, '[\x00-\x1F\x7F\x{{FFFD}}]'))) > 0 THEN 'value'
    WHEN NOT regexp_full_match(ts[3], '[^@\s\p{{Z}}\x{{85}}]+@[^@\s\p{{Z}}\x{{85}}]+') OR NOT regexp_full_match(ts[4], '[0-9a-f]{{40}}') THEN 'value'
    WHEN w.y < '0001' OR base IS NULL OR w.c >= '24' OR w.z[2:3] > '23' OR w.z[5:6] > '59' THEN 'value' END AS reason FROM t)
"""

_P4 = """
WITH u AS (
  SELECT 'commit_author_name' AS field, commit_author_name AS k, repository_id AS r, commit_author_when AS w FROM commits
  UNION ALL
  SELECT 'commit_author_email', commit_author_email, repository_id, commit_author_when FROM commits
)
"""

SQL = {
    "sig_group_max": _with(_GROUP) + "SELECT repo, name, email, hash, timezone('UTC', ts) AS ts FROM src",
    "strip_accents": _scalar(_N, "plain", _plain("value")),
    "collapse_blanks": _scalar(_N, "collapsed", f"regexp_replace(value, '{_BLANK}', ' ', 'g')"),
    "clean_names": _scalar(_N, "cleaned", _clean("value")),
    "clean_emails": _scalar(_M, "cleaned", _clean("value")),
    "clean_names_keep_case": _scalar(_N, "tidied", _tidy("value", False)),
    "remove_parens": _scalar(_N, "without", r"regexp_replace(value, '([^(])[\t\n\f\r ][(][^)]+[)]', '\1', 'g')"),
    "pred_capitalized": _scalar(_N, "flag", r"regexp_matches(value, '^\p{Lu}')"),
    "pred_latin_letters": _scalar(_N, "flag", "regexp_matches(value, '[a-zA-Z]')"),
    "pred_multi_email": _mail(_MULTI),
    "pred_domain": _mail(_in(_LAST, "domains")),
    "pred_tld": _mail(_in(f"string_split({_LAST}, '.')[-1]", "top_level_domains")),
    "pred_single_label": _mail(f"NOT contains({_LAST}, '.')"),
    "pred_ip": _mail(_ip(_LAST)),
    "pred_listed_email": _mail(_in("email", "emails")),
    "pred_popular_email": _mail(_in("email", "popular_emails")),
    "pred_ignored_email": _mail(_IGNORED_MAIL),
    "pred_ignored_name": _name(_IGNORED_NAME),
    "pred_popular_name": _name(_in("name", "popular_names")),
    "filter_lists_clean": _with(_LISTS) + "SELECT * FROM fl",
    "signature_labels": _with(_GROUP) + f"SELECT row_ix, {_SHOW} AS label FROM src",
    "csv_cache": _with(_SIG) + f"SELECT {_clean('repo')} AS repo, name, email, {_clean('hash')} AS hash, timezone('UTC', ts) AS ts FROM sig",
    "people_filtered": _with(_SIG) + "SELECT id, name, repo, email, hash, sample_repo FROM people_",
    "popular_scope": _with(_SIG) + "SELECT id, name, repo FROM people_ WHERE repo <> ''",
    "name_keys": _with(_SIG) + "SELECT id, name_key FROM pk",
    "name_freq": _with(_SIG) + _freq("name"),
    "email_freq": _with(_SIG) + _freq("email"),
    "reversed_index": _with(_SIG) + "SELECT 'email' AS attribute, email AS value, id FROM pk UNION SELECT 'name', name, id FROM pk",
    "reversed_index_sizes": _with(_SIG)
    + "SELECT attribute, value, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT 'email' AS attribute, email AS value, id FROM pk UNION SELECT 'name', name, id FROM pk) GROUP BY 1, 2",
    "first_seen": _with(_SIG, _FIRST) + "SELECT * FROM fs",
    "popular_learned_names": _with(_SIG)
    + f"SELECT name AS key, count(DISTINCT email) AS n_values FROM sig WHERE NOT {_IGNORED_NAME} AND NOT {_IGNORED_MAIL} GROUP BY 1 HAVING count(DISTINCT email) >= 5",
    "popular_learned_emails": _with(_SIG)
    + f"SELECT email AS key, count(DISTINCT name) AS n_values FROM sig WHERE NOT {_IGNORED_NAME} AND NOT {_IGNORED_MAIL} GROUP BY 1 HAVING count(DISTINCT name) >= 6",
    "email_edges": _with(_SIG) + f"SELECT id, r AS anchor FROM (SELECT id, min(id) OVER (PARTITION BY k) AS r FROM ({_MAILS})) WHERE id <> r",
    "name_edges": _with(_SIG) + f"SELECT id, r AS anchor FROM (SELECT id, min(id) OVER (PARTITION BY k) AS r FROM ({_NAMES})) WHERE id <> r",
    "email_components": _with(_SIG, _BY_MAIL) + "SELECT * FROM lab",
    "all_components": _with(_SIG, _ALL) + "SELECT * FROM lab",
    "component_stats": _with(_SIG, _ALL)
    + "SELECT count(*) AS n_components, round(coalesce(avg(n), 0.0), 6) AS size_mean, round(coalesce(stddev_samp(n), 0.0), 6) AS size_std, coalesce(max(n), 0) AS size_max FROM (SELECT component, count(*) AS n FROM lab GROUP BY 1)",
    "merged_identities": _with(_SIG, _ALL, _MERGED) + "SELECT * FROM m",
    "person_labels": _with(_SIG, _ALL, _MERGED) + "SELECT id, concat('<no external id>:', names, '||', emails) AS label FROM m",
    "aliases": _with(_SIG, _ALL, _ALIASES) + "SELECT * FROM al",
    "primary_name": _with(_SIG, _ALL) + "SELECT * FROM " + _primary("name"),
    "primary_email": _with(_SIG, _ALL) + "SELECT * FROM " + _primary("email"),
    "identities": _with(_SIG, _ALL, _IDENTITIES) + "SELECT * FROM idn",
    "limited_components": _with(_SIG, _limited(20)) + "SELECT id, component FROM lab",
    "limited_components_4": _with(_SIG, _limited(4)) + "SELECT id, component, replayed FROM lab",
    "limited_identities": _with(_SIG, _limited(20), _IDENTITIES) + "SELECT * FROM idn",
    "limit_fastpath": _with(_SIG, _ALL)
    + "SELECT id, component FROM lab WHERE component IN (SELECT component FROM pk JOIN lab USING (id) GROUP BY 1 HAVING count(DISTINCT email) + count(DISTINCT name_key) < 20)",
    "research_union_find": _with(
        _SIG, _FIRST, "nodes AS (SELECT ix AS id FROM fs)",
        _components("nodes", f"SELECT ix AS id, email AS k FROM fs WHERE NOT {_in('email', 'popular_emails')}", f"SELECT ix AS id, name AS k FROM fs WHERE NOT {_in('name', 'popular_names')}"),
    ) + "SELECT * FROM lab",
    "ext_accounts": _with(_SIG, _ACCOUNTS) + "SELECT id, email, coalesce(u, '') AS external_id FROM pk LEFT JOIN acc USING (email)",
    "ext_unmatched": _with(_SIG, _ACCOUNTS) + "SELECT DISTINCT email FROM pk WHERE email NOT IN (SELECT email FROM acc)",
    "ext_bridge": _with(_SIG, _ACCOUNTS)
    + f"""SELECT name_key, min(a) AS src, max(a) AS dst FROM (SELECT name_key, coalesce(u, '') AS x, min(id) AS a FROM pk LEFT JOIN acc USING (email)
  WHERE NOT {_in('name_key', 'popular_names')} GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 2 AND bool_or(x = '')""",
    "resolve_commits": _with(_SIG, _ALL, _ALIASES)
    + f"""SELECT row_ix, coalesce(a.id, b.id, c.id) AS identity_id, CASE WHEN a.id IS NOT NULL THEN 'email' WHEN b.id IS NOT NULL THEN 'name in repository' WHEN c.id IS NOT NULL THEN 'name' END AS matched_by
  FROM (SELECT row_ix, repository_id AS repo, {_clean(_N)} AS name, {_clean(_M)} AS email FROM commits) x
  LEFT JOIN (SELECT email, min(id) AS id FROM al WHERE email <> '' GROUP BY 1) a ON x.email = a.email
  LEFT JOIN (SELECT name, repo, min(id) AS id FROM al WHERE name <> '' AND repo <> '' GROUP BY 1, 2) b ON x.name = b.name AND x.repo = b.repo
  LEFT JOIN (SELECT name, min(id) AS id FROM al WHERE name <> '' AND repo = '' GROUP BY 1) c ON x.name = c.name""",
    "eval_pairs": _with(_SIG, _BY_MAIL, _ACCOUNTS, _SCORES) + "SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1) FROM sc",
    "eval_macro": _with(_SIG, _BY_MAIL, _ACCOUNTS, _SCORES) + "SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM sc",
    "eval_weighted": _with(_SIG, _BY_MAIL, _ACCOUNTS, _SCORES)
    + "SELECT round(sum(precision * found_size) / sum(found_size), 6) AS precision, round(sum(recall * found_size) / sum(found_size), 6) AS recall, round(sum(f1 * found_size) / sum(found_size), 6) AS f1 FROM sc",
    "eval_identity_pairs": _with(_SIG, _ALL, _ACCOUNTS, _OWN) + "SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1) FROM sc",
    "eval_identity_macro": _with(_SIG, _ALL, _ACCOUNTS, _OWN) + "SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM sc",
    "eval_identity_weighted": _with(_SIG, _ALL, _ACCOUNTS, _OWN)
    + "SELECT round(sum(precision * found_size) / sum(found_size), 6) AS precision, round(sum(recall * found_size) / sum(found_size), 6) AS recall, round(sum(f1 * found_size) / sum(found_size), 6) AS f1 FROM sc",
    "metrics_counts": _with(_SIG, _ALL, _ACCOUNTS, _COUNTS) + "SELECT key, round(value::DOUBLE, 6) AS value FROM k",
    "metrics_json": _with(_SIG, _ALL, _ACCOUNTS, _COUNTS)
    + """SELECT concat('{', string_agg(concat('"', key, '":', round(value::DOUBLE, 6)), ',' ORDER BY key), '}') AS json FROM k WHERE value <> 0""",
    "tables_round_trip": _with(_SIG, _ALL, _MERGED, _IDENTITIES)
    + "SELECT id, len(string_split(names, '|')) AS n_names, emails, primary_name, primary_email, external_id FROM m JOIN idn USING (id)",
    "p4_found": _P4
    + """SELECT field, k AS hot_value FROM u WHERE k IS NOT NULL GROUP BY field, k
HAVING count(*) >= 0.01 * (SELECT count(*) FROM commits)""",
    "p6_found": _LINES + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p6_valid": _LINES
    + """SELECT line_id, fs[1] AS repository_id, fs[2] AS commit_author_name, fs[3] AS commit_author_email, ts[4] AS commit_hash,
  base + to_microseconds(rpad(w.f[1:6], 6, '0')::BIGINT) - CASE WHEN w.z = 'Z' THEN INTERVAL 0 MINUTE
    ELSE to_minutes((w.z[1] || '1')::BIGINT * (w.z[2:3]::BIGINT * 60 + w.z[5:6]::BIGINT)) END AS commit_author_when FROM r WHERE reason IS NULL""",
    "p4_keys": _P4
    + """SELECT field, k AS key, count(*) AS n_rows, count(DISTINCT r) AS n_repositories,
  timezone('UTC', min(w)) AS first_when, timezone('UTC', max(w)) AS last_when FROM u WHERE k IS NOT NULL GROUP BY field, k""",
}
