"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from . import lexical, licenses, secrets
from .quality import STOP_WORDS, THRESHOLDS

_WHITE = "[\\x09-\\x0D\\x20]"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _broken(top: str, bottom: str, least, most, since: int) -> str:
    parts = [f"{top} < CAST({least} AS DOUBLE) * {bottom}"] * (least is not None) + [f"{top} > CAST({most} AS DOUBLE) * {bottom}"] * (most is not None)
    return f"(n_words >= {since} AND ({' OR '.join(parts)}))"


OP6 = f"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WHITE}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D\\x20]')) AS l FROM documents),
five AS (SELECT doc_id, CAST(i AS BIGINT) AS i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d) x),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM five) y WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) k GROUP BY doc_id),
c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_WHITE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(a.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop,
         length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper
  FROM d LEFT JOIN again a ON a.doc_id = d.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(_broken(*r[1:]) for r in THRESHOLDS)}) AS kept FROM b"""


def _matches(no: int, pattern: str, group: int, least: int) -> str:
    """doc_id, owner, repo, no, start, stop, value of the matches of one kind; starts are running sums."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, owner, repo, {no} AS no, upto - length(w) AS start, upto AS stop, v FROM (
      SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
        SELECT doc_id, owner, repo, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS w, unnest(vs) AS v, unnest(gaps[1:len(ws)]) AS gap FROM (
          SELECT *, regexp_extract_all(t, {p}) AS ws, regexp_extract_all(t, {p}, {group}) AS vs, regexp_split_to_array(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})) a) b) c
    WHERE length(v) >= {least}"""


_N = len(secrets.BASE)
_SPAN = "CASE no " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secrets.KINDS)) + " END || ':' || start || ':' || stop"
OP8 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
base AS ({' UNION ALL '.join(_matches(i, *k[1:]) for i, k in enumerate(secrets.BASE))}),
more AS ({' UNION ALL '.join(_matches(_N + i, *k[1:]) for i, k in enumerate(secrets.MORE))}),
found AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.start < m.stop AND m.start < b.stop)),
owned AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM found GROUP BY v),
judged AS (
  SELECT f.*, o.owners, o.repos, CASE WHEN o.owners >= {secrets.MANY_OWNERS} OR o.owners >= 2 AND o.repos >= {secrets.MANY_REPOS} THEN 'example'
    WHEN len(list_distinct(string_split(f.v, ''))) >= 8 AND (regexp_matches(f.v, '[0-9]') OR regexp_matches(f.v, '[A-Z]') AND regexp_matches(f.v, '[a-z]')) THEN 'live' ELSE 'plain' END AS verdict
  FROM found f JOIN owned o ON f.v = o.v),
told AS (
  SELECT doc_id, {', '.join(f'count(*) FILTER (no = {i}) AS n_{k[0]}' for i, k in enumerate(secrets.BASE))}, string_agg({_SPAN}, ',' ORDER BY start, no) FILTER (no < {_N}) AS base,
         string_agg({_SPAN}, ',' ORDER BY start, no) FILTER (no < {_N} OR verdict <> 'example') AS spans,
         string_agg({_SPAN} || ':' || verdict || ':' || owners || ':' || repos, ',' ORDER BY start, no) AS verdicts
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k[0]}, 0) AS n_{k[0]}' for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(verdicts, '') AS verdicts
FROM d LEFT JOIN told ON d.doc_id = told.doc_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _terms(text: str) -> str:
    """List of the terms of a text, without common words."""
    parts = f"list_transform(regexp_split_to_array(lower({text}), '{licenses.SEPARATORS}'), lambda x: trim(x, '.+-'))"
    return f"list_filter({parts}, lambda x: x <> '' AND x NOT IN ({', '.join(map(_quoted, licenses.COMMON))}))"


def _values(templates) -> str:
    return ", ".join(f"({k}, {_quoted(name)}, {_quoted(text)})" for k, (name, text) in enumerate(templates))


_COMMENT, _SOLID = _quoted(licenses.COMMENT), _quoted(licenses.SOLID)


def _scored(at: str, values: str, wanted: str) -> str:
    """Relations of one set of templates: their vectors, and of the units (i, r, ts, share) the score of each template that reaches the least one."""
    return f"""template{at}(k, name, body) AS (VALUES {values}),
wanted{at} AS (SELECT k, name, term, count(*) AS n FROM (SELECT k, name, unnest({wanted}) AS term FROM template{at}) x GROUP BY k, name, term),
idf{at} AS (SELECT term, ln((1 + (SELECT count(*) FROM template{at})) / (1 + count(*))) + 1 AS w FROM wanted{at} GROUP BY term),
vector{at} AS (SELECT k, name, wanted{at}.term, wanted{at}.n * w / sqrt(sum(wanted{at}.n * w * wanted{at}.n * w) OVER (PARTITION BY k)) AS x FROM wanted{at} JOIN idf{at} ON wanted{at}.term = idf{at}.term),
held{at} AS (SELECT i, lt.term, lt.n, w FROM (SELECT i, term, count(*) AS n FROM (SELECT i, unnest(ts) AS term FROM unit{at}) y GROUP BY i, term) lt JOIN idf{at} ON idf{at}.term = lt.term),
near{at} AS (
  SELECT held{at}.i, sqrt(sum(n * w * n * w)) AS norm FROM held{at} JOIN unit{at} ON unit{at}.i = held{at}.i GROUP BY held{at}.i
  HAVING sum(n) >= any_value(share) * any_value(len(ts)) AND count(*) >= {licenses.KNOWN}),
hit{at} AS (
  SELECT r, CASE WHEN name = '{licenses.RESERVED}' THEN {licenses.RESERVE} ELSE rank END AS rank, k, name, score FROM (
    SELECT near{at}.i, k, name, round(sum(n * w * x) / any_value(norm), 4) AS score FROM near{at} JOIN held{at} ON held{at}.i = near{at}.i JOIN vector{at} ON vector{at}.term = held{at}.term GROUP BY near{at}.i, k, name) s
  JOIN unit{at} ON unit{at}.i = s.i WHERE score >= {licenses.LEAST})"""


_PARTS = f"list_filter(list_transform(regexp_extract_all(lower({{}}), '[{licenses.WORD}]+')[1:{licenses.PARTS}], lambda x: trim(x, '.+-')), lambda x: x <> '' AND x NOT IN ({', '.join(map(_quoted, licenses.COMMON))}))[1:{licenses.OPENING}]"
_OPENING = _terms("body") + f"[1:{licenses.OPENING}]"
OP10 = f"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls, concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'unknown'),
         coalesce(CAST(doc_id // 10000 AS VARCHAR), 'none'), coalesce(CAST(doc_id // 100 AS VARCHAR), 'none')) AS dir FROM documents),
piece AS (
  SELECT r, unnest(list_concat(list_transform(ls, lambda l: {{'u': l, 'rank': {licenses.LINE}}}), list_transform(list_filter(regexp_split_to_array(array_to_string(list_transform(ls, lambda l: CASE WHEN regexp_matches(l, {_SOLID}) THEN l ELSE '' END), chr(10)), '\n\n+'), lambda p: contains(p, chr(10))), lambda p: {{'u': p, 'rank': {licenses.BLOCK}}}),
         list_transform([array_to_string(ls[1:coalesce(nullif(list_position(list_transform(ls, lambda l: regexp_matches(l, {_COMMENT}) OR NOT regexp_matches(l, {_SOLID})), false), 0), len(ls) + 1) - 1], chr(10))], lambda h: {{'u': h, 'rank': CASE WHEN contains(h, chr(10)) THEN {licenses.BLOCK} ELSE {licenses.LINE} END}}))) AS p FROM d),
unit AS (SELECT row_number() OVER () AS i, r, rank, share, {_terms('u')} AS ts FROM (
  SELECT r, p.rank AS rank, {licenses.SHARE} AS share, p.u AS u FROM piece UNION ALL SELECT r, {licenses.WHOLE}, {licenses.FILE_SHARE}, t FROM d) x),
unit_o AS (SELECT r AS i, r, {licenses.OPENED} AS rank, {licenses.SHARE} AS share, {_PARTS.format('t')} AS ts FROM d),
{_scored('', _values(licenses.TEMPLATES), _terms('body'))},
{_scored('_o', _values(licenses.OPENINGS), _OPENING)},
every AS (SELECT * FROM hit UNION ALL SELECT * FROM hit_o),
own AS (SELECT r, name AS licence, score FROM every QUALIFY row_number() OVER (PARTITION BY r ORDER BY rank DESC, score DESC, k) = 1),
file AS (SELECT d.r, doc_id, dir, licence, score, EXISTS (SELECT 1 FROM every WHERE every.r = d.r AND rank >= {licenses.WHOLE}) AS stated FROM d LEFT JOIN own ON own.r = d.r),
theirs AS (SELECT dir, licence FROM file WHERE stated GROUP BY dir, licence QUALIFY row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, licence) = 1),
up AS (SELECT dir, unnest(list_append(list_transform(generate_series(1, len(string_split(dir, '/'))), lambda i: array_to_string(string_split(dir, '/')[1:i], '/')), '')) AS above FROM (SELECT DISTINCT dir FROM file) x),
nearest AS (SELECT up.dir, above, licence FROM up JOIN theirs ON theirs.dir = above QUALIFY row_number() OVER (PARTITION BY up.dir ORDER BY length(above) DESC) = 1)
SELECT doc_id, coalesce(f.licence, n.licence, 'none') AS licence, CASE WHEN f.licence IS NOT NULL THEN 'own' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       f.score, CASE WHEN f.licence IS NULL THEN above END AS licensed_by
FROM file f LEFT JOIN nearest n ON n.dir = f.dir"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _term_list(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_term_list('text')} AS ts FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) AS nd, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_term_list('text')}) AS term FROM benchmark) x GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, total GROUP BY term, nd),
adds AS (SELECT r, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))) AS x FROM p JOIN w ON w.term = p.term, total),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(times * x) AS BIGINT) AS score FROM q JOIN adds ON adds.term = q.term GROUP BY i, item_id, r, doc_id HAVING sum(times * x) > 0),
best AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= {lexical.TOP}"""

_ONE = "(SELECT unnest([0, 1, 2, 3, 4]) AS f)"
_FAILS = "CAST(substr(fails, {} + 1, 1) AS INTEGER)"
OP13 = f"""WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WHITE}+'), lambda x: x <> '') AS w FROM documents),
lowest AS (SELECT t, min(doc_id) AS low FROM words GROUP BY t),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
bits AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(w) < 50 AS INTEGER) || CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER)
    || CAST(100 * (length(words.t) - length(regexp_replace(words.t, '[A-Z]', '', 'g'))) > 5 * length(words.t) AS INTEGER) || CAST(regexp_matches(words.t, '[#$%&*|]') AS INTEGER) || CAST(coalesce(words.doc_id > low, false) AS INTEGER) AS fails
  FROM words JOIN lowest ON lowest.t = words.t LEFT JOIN marks ON marks.doc_id = words.doc_id),
cell AS (SELECT part, fails, good, toxic, count(*) AS n FROM bits GROUP BY ALL),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM {_ONE} a, {_ONE} b, {_ONE} c, {_ONE} d, {_ONE} e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
told AS (
  SELECT part, o, step, n, good, toxic, fails, {_FAILS.format('o[step]')} = 1 AS mine, list_sum(list_transform(o[1:step - 1], lambda f: {_FAILS.format('f')})) > 0 AS before
  FROM cell, steps),
seen AS (SELECT *, coalesce(before, false) AS gone FROM told),
by_step AS (
  SELECT part, o, step, sum(n) FILTER (NOT mine AND NOT gone) AS kept, sum(n) FILTER (mine AND NOT gone) AS removed, sum(n) FILTER (mine AND gone) AS redundant,
         sum(n) FILTER (mine AND length(replace(fails, '0', '')) = 1) AS unique_fails, sum(n) FILTER (mine AND NOT gone AND good) AS good_lost, sum(n) FILTER (mine AND NOT gone AND toxic) AS toxic_lost
  FROM seen GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda f: chr(CAST(65 + f AS INTEGER))), '') AS filter_order, CAST(step AS INTEGER) AS step,
       {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley FROM by_step"""

ORACLE_SQL: dict[str, str] = {"op6_quality_rules": OP6, "op8_secret_scan": OP8, "op10_license_scan": OP10, "op12_lexical_search": OP12, "op13_filter_audit": OP13}
