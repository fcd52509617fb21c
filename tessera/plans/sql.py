"""Fragments of DuckDB SQL that several queries share, written from the rules and not from the library's constants."""

from __future__ import annotations

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(text: str) -> str:
    return f"trim({text}, {WHITE})"


def _words(text: str) -> str:
    return rf"regexp_extract_all({text}, '\S+')"


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _listed(values: str) -> str:
    return "(" + ", ".join(f"'{v.strip()}'" for v in values.split(",")) + ")"


_NAVIGATION = _listed("home, about, contact, sitemap, privacy, terms, cookie, cookies, disclaimer, accessibility, copyright, donate, help, search, navigation, menu, toggle, tools, languages, contents")
_FUNCTION = _listed(
    "the, a, an, is, are, was, were, be, been, being, have, has, had, do, does, did, will, would, could, should, may, might, can, shall, to, of, in, for, on, with, at, by, from, as, into, through, "
    "during, before, after, above, below, between, under, again, further, then, once, here, there, when, where, why, how, all, each, every, both, few, more, most, other, some, such, no, nor, not, only, "
    "own, same, so, than, too, very, just, because, but, and, or, if, while, although, this, that, these, those, which, who, whom, what, it, its, they, them, their, we, us, our, you, your, he, him, his, "
    "she, her, hers"
)
_LABELS = _listed(
    "toggle, navigation, tools, search, menu, footer, header, sidebar, actions, settings, options, preferences, languages, language, share, print, download, export, import, help, about, contact, privacy, "
    "terms, cookie, cookies, disclaimer, license, licence, copyright, accessibility, skip to content, table of contents, on this page, in this article, related pages, see also, external links, "
    "further reading, bibliography, notes, citations, sources, references, download pdf, printable version, appearance, donate, upload file, contribute, edit this page, create account, log in"
)
_ACTIONS = _listed("edit, view, read, share, print, download, search, toggle, donate, upload, help, tools, login, logout, signup, register, subscribe")
_SCRIPTS = ("0370-03FF", "0400-04FF", "0600-06FF", "0900-097F", "0E00-0E7F", "4E00-9FFF", "AC00-D7AF", "3040-309F", "30A0-30FF", "1780-17FF", "0F00-0FFF", "1000-109F", "1200-137F", "0590-05FF")


def navigation(x: str) -> str:
    """Whether the text ``x``, without white space at its ends, is navigation."""
    ends, names, words = f"regexp_matches({x}, '[.!?]')", f"regexp_extract_all(lower({x}), '[a-z]+')", _words(x)
    hits = f"len(list_filter({names}, lambda w: w IN {_NAVIGATION}))"
    cells = f"list_filter(list_transform(string_split({x}, '|'), lambda c: {strip('c')}), lambda c: c <> '')"
    rich = "(length(c) > 20 OR contains(c, '://') OR contains(c, '`'))"
    row = rf"""(contains({x}, '|') AND len({cells}) >= 3 AND (len(list_filter({cells}, lambda c: regexp_matches(c, '^[\s:-]+$'))) = len({cells}) OR (len(list_filter({cells}, lambda c: contains(c, ' '))) > 0
  AND (list_sum(list_transform({cells}, lambda c: length(c))) > 5 * len({cells}) OR len(list_filter({cells}, lambda c: {rich})) > 0))))"""
    bars = rf"({_n(x, '[|]')} >= 2 AND NOT regexp_matches({x}, '[^\s|]\s+[^\s|]') AND (regexp_matches({x}, '^(\w+\s*\|\s*){{3,}}$') OR regexp_matches({x}, '\S\s*\|\s*\S{{2,}}\s*\|\s*\S')))"
    scripts = " + ".join("CAST(regexp_matches({}, '[\\x{{{}}}-\\x{{{}}}]') AS INTEGER)".format(x, *s.split("-")) for s in _SCRIPTS)
    english = f"len(list_filter(regexp_extract_all(lower({x}), '[a-z'']+'), lambda w: w IN {_FUNCTION}))"
    lines = f"string_split({x}, chr(10))"
    questions = f"(len({lines}) >= 3 AND length({strip(lines + '[1]')}) < 50 AND len({_words(lines + '[1]')}) <= 5 AND len(list_filter({lines}[2:], lambda q: NOT ends_with({strip('q')}, '?'))) = 0)"
    return rf"""(length({x}) < 20 OR (NOT {row} AND ({bars} OR ({_n(x, '[•·>»]')} >= 2 AND length({x}) < 200) OR ({hits} >= 2 AND len({names}) <= 8) OR (regexp_matches(lower({x}), 'cookie|consent|gdpr|ccpa') AND len({names}) <= 12)
 OR length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')) < 10 OR (NOT {ends} AND ((len({words}) >= 5 AND 2 * len(list_filter({words}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) >= len({words})) OR (length({x}) < 50 AND {_n(x, '[a-z]+[A-Z][a-z]+')} > 0)
  OR {_n(x, '[a-z]+[A-Z][a-z]+')} >= 3 OR {_n(x, 'List of ')} >= 2)) OR ({_n(x, '[a-z][A-Z]')} >= 3 AND (length({x}) < 80 OR NOT {ends})) OR ({hits} >= 3 AND len({words}) <= 12)
 OR (len({names}) > 0 AND lower({words}[1]) IN ('read', 'edit', 'view', 'download', 'printable', 'subscribe', 'follow') AND len({words}) <= 10)
 OR (length({x}) < 80 AND contains({x}, '(') AND ends_with({x}, ')') AND regexp_matches({x}, '^\p{{Lu}}') AND NOT {ends}) OR ({scripts} >= 3 AND {english} < 5) OR {questions})))"""


def heading(x: str, ahead: str, copies: str) -> str:
    """The title that the line ``x`` is, else null."""
    words = _words(x)
    score = rf"""coalesce(list_sum(list_transform({ahead}, lambda a: CASE WHEN a = '' THEN 0.0 ELSE CASE WHEN regexp_matches(a, '[.!?]\s') AND length(a) > 50 THEN 2.0 WHEN length(a) > 80 THEN 1.0 WHEN length(a) < 25 THEN -0.5 ELSE 0.0 END
  + CASE WHEN regexp_matches(a, '^[A-Z][A-Za-z\s]{{3,50}}:?$') AND len({_words('a')}) < 10 THEN -0.5 ELSE 0.0 END END)), 0)"""
    return rf"""CASE WHEN len({words}) BETWEEN 1 AND 12 AND length({x}) <= 80 AND regexp_matches({x}, '^\p{{Lu}}') AND NOT regexp_matches({x}, '[.!?:]$') AND lower({x}) NOT IN {_LABELS}
 AND NOT (len({words}) <= 3 AND (lower({words}[1]) IN {_LABELS} OR len(list_filter({words}, lambda w: lower(w) IN {_ACTIONS})) > 0))
 AND NOT ({score} <= 0 AND len(list_filter(coalesce({ahead}, []), lambda a: a = '')) >= 2) AND {copies} < 3 AND 2 * len(list_filter({words}[2:], lambda w: regexp_matches(w, '^\p{{Ll}}'))) <= len({words}) - 1
 THEN nullif({strip(f"regexp_replace({x}, '[#*_`]', '', 'g')")}, '') END"""


#: Lines of documents with what stands ahead and how often they occur: tl(doc_id, i, x, title) and whether they are navigation.
SECTIONS = rf"""
rl AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
xl AS (SELECT doc_id, i, raw, {strip('raw')} AS x FROM rl),
al AS (SELECT *, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead, count(*) FILTER (WHERE raw = x) OVER (PARTITION BY doc_id, x) AS copies FROM xl),
tl AS (SELECT doc_id, i, x, CASE WHEN regexp_matches(x, '^#{{1,6}}\s+.*$') THEN regexp_replace({strip(r"regexp_extract(x, '^#{1,6}\s+(.*)$', 1)")}, '[#*_`]', '', 'g') WHEN regexp_matches(x, '^[A-Z\s]{{5,30}}$') THEN x
  ELSE {heading('x', 'ahead', 'copies')} END AS title FROM al WHERE x <> ''),
sl AS (SELECT *, coalesce(last_value(nullif(title, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Main Content') AS section FROM tl),
pl AS (SELECT *, CASE WHEN section = 'Main Content' THEN -1 ELSE min(i) OVER (PARTITION BY doc_id, section) END AS place FROM sl),
gl AS (SELECT doc_id, section, place, list(x ORDER BY i) AS lines FROM pl WHERE title IS NULL AND length(x) > 10 AND NOT {navigation('x')} GROUP BY ALL),
jl AS (SELECT doc_id, CASE WHEN len(list_filter(lines, lambda l: regexp_matches(l, '[.!?](\s|$)') OR length(l) > 80 OR (length(l) > 40 AND regexp_matches(lower(l), 'the |is |are |was ')))) >= 2
  OR (len(lines) = 1 AND (length(lines[1]) > 150 OR (length(lines[1]) >= 40 AND regexp_matches(lines[1], '[.!?](\s|$)'))))
  OR (len(lines) >= 3 AND list_max(list_transform(lines, lambda l: length(l))) > 100 AND list_max(list_transform(lines, lambda l: length(l))) > 3 * greatest(list_min(list_transform(lines, lambda l: length(l))), 1))
  THEN section ELSE 'Main Content' END AS section, place, lines FROM gl),
sections AS (SELECT doc_id, section, flatten(list(lines ORDER BY place)) AS lines FROM jl GROUP BY doc_id, section)"""

#: paragraphs(doc_id, n, p): those between blank lines; where these are one or none, lines gathered one after the other.
PARAGRAPHS = rf"""
bp AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM (SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '\n\s*\n'), lambda q: {strip('q')}) AS ps FROM documents)),
gp AS (SELECT * FROM bp WHERE length(p) >= 40 AND length(regexp_replace(p, '[^\p{{L}}]', '', 'g')) >= 0.4 * length(p) AND NOT {navigation('p')}),
few AS (SELECT doc_id, text FROM documents WHERE (SELECT count(*) FROM gp WHERE gp.doc_id = documents.doc_id) <= 1),
ll AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, {strip('x')} AS x, i FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM few)) WHERE x <> ''),
la AS (SELECT *, list(x) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead, count(*) OVER (PARTITION BY doc_id, x) AS copies FROM ll),
lm AS (SELECT doc_id, k, x, {navigation('x')} AS nav, {heading('x', 'ahead', 'copies')} IS NOT NULL AS title FROM la),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, '' AS open, 0 AS n, CAST(NULL AS VARCHAR) AS done FROM few
  UNION ALL
  SELECT w.doc_id, w.k + 1,
    CASE WHEN nav THEN CASE WHEN w.n >= 4 OR (w.n > 0 AND regexp_matches(w.open, '[.!")]$')) THEN '' ELSE w.open END WHEN title OR w.n = 0 OR (w.n >= 3 AND length(x) > 10 AND regexp_matches(x, '^\p{{Lu}}') AND regexp_matches(w.open, '[.!")]$')) THEN x ELSE w.open || ' ' || x END,
    CASE WHEN nav THEN CASE WHEN w.n >= 4 OR (w.n > 0 AND regexp_matches(w.open, '[.!")]$')) THEN 0 ELSE w.n END WHEN title OR w.n = 0 OR (w.n >= 3 AND length(x) > 10 AND regexp_matches(x, '^\p{{Lu}}') AND regexp_matches(w.open, '[.!")]$')) THEN 1 ELSE w.n + 1 END,
    CASE WHEN nav THEN CASE WHEN w.n >= 4 OR (w.n > 0 AND regexp_matches(w.open, '[.!")]$')) THEN w.open END WHEN w.n > 0 AND (title OR (w.n >= 3 AND length(x) > 10 AND regexp_matches(x, '^\p{{Lu}}') AND regexp_matches(w.open, '[.!")]$'))) THEN w.open END
  FROM walk w JOIN lm ON lm.doc_id = w.doc_id AND lm.k = w.k + 1),
ended AS (SELECT doc_id, k, done AS p FROM walk WHERE done IS NOT NULL UNION ALL SELECT doc_id, k + 1, open FROM walk WHERE n > 0 AND k = (SELECT count(*) FROM lm WHERE lm.doc_id = walk.doc_id)),
paragraphs AS (
  SELECT doc_id, n, p FROM gp WHERE doc_id NOT IN (SELECT doc_id FROM few)
  UNION ALL SELECT doc_id, k, p FROM ended WHERE length(p) >= 40 AND (length(p) >= 200 OR regexp_matches(p, '[.!?]\s') OR (length(p) >= 100 AND length(regexp_replace(p, '[^\p{{L}}]', '', 'g')) > 0.5 * length(p))))"""


def near_duplicates(rows: str, pos: str, title: str = "title", url: str = "url", content: str = "content") -> str:
    """CTEs that end in ``cluster_of(pos, cluster)``: components of texts with half their word triples in common, named by their smallest ``pos``.  Needs WITH RECURSIVE."""
    text = f"concat_ws(' ', trim(coalesce({title}, '')), replace(regexp_extract(coalesce({url}, ''), '^https?://([^/]+)', 1), 'www.', ''), substring(coalesce({content}, ''), 1, 500))"
    return rf"""
nw AS (SELECT {pos} AS pos, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+') AS w FROM {rows}),
ns AS (SELECT pos, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM nw),
nr AS (SELECT min(pos) AS rep, s FROM ns GROUP BY s),
nx AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM nr),
np AS (SELECT a.rep AS a, b.rep AS b FROM nx a JOIN nx b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.5 * (a.n + b.n - count(*))),
nc(node, other) AS (SELECT rep, rep FROM nr UNION SELECT nc.node, np.b FROM nc JOIN np ON np.a = nc.other),
nm AS (SELECT node, min(other) AS cluster FROM nc GROUP BY node),
cluster_of AS (SELECT ns.pos, nm.cluster FROM ns JOIN nr ON ns.s = nr.s JOIN nm ON nm.node = nr.rep)"""
