"""Queries on de-duplication, facets, feeds, URLs and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, html, urls
from ..operators import dedup, facets, feeds, graph, ingest
from .common import CAND, NOW_TEXT, candidates, count_sql, host_sql, now, query, table

_ENTRY = f"""{CAND}, ent AS (SELECT pos, title, snippet AS summary, source AS author, url, content_type AS domain, publish_date AS published, 'https://' || lang || '.feeds.example.org/rss' AS feed_url, '' AS guid FROM cand)"""


def entries(spark, d):
    return candidates(spark, d).select(
        "pos", "title", F.col("snippet").alias("summary"), F.col("source").alias("author"), "url", F.col("content_type").alias("domain"), F.col("publish_date").alias("published"),
        F.concat(F.lit("https://"), "lang", F.lit(".feeds.example.org/rss")).alias("feed_url"), F.lit("").alias("guid"),
    )


@query("facet_counts", rf"""WITH {CAND}, f AS (SELECT unnest([{{'facet': 'domain', 'value': {host_sql('url')}}}, {{'facet': 'date', 'value': substring(publish_date, 1, 7)}}, {{'facet': 'source', 'value': lower(source)}}, {{'facet': 'language', 'value': substring(lower(lang), 1, 2)}}]) AS f FROM cand),
c AS (SELECT f.facet AS facet, f.value AS value, count(*) AS count FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS k FROM c)
SELECT facet, value, count FROM r WHERE k <= 50""")
def facet_counts(spark, d):
    return facets.facets(candidates(spark, d))


@query("facet_drill_down", f"WITH {CAND} SELECT pos FROM cand WHERE {host_sql('url')} = 'bbc.com'")
def facet_drill_down(spark, d):
    return facets.drill_down(candidates(spark, d), "domain", "bbc.com").select("pos")


@query("top_authors", f"""WITH {_ENTRY}, c AS (SELECT author, count(*) AS count FROM ent WHERE lower(author) NOT IN ('unknown', 'anonymous', 'n/a') AND trim(author) <> '' GROUP BY author ORDER BY count DESC, author LIMIT 10)
SELECT author, count, (SELECT list(pos ORDER BY pos) FROM (SELECT pos FROM ent e WHERE e.author = c.author ORDER BY pos LIMIT 5)) AS articles FROM c""")
def top_authors(spark, d):
    return facets.top_authors(entries(spark, d))


@query("top_keywords", f"""WITH {_ENTRY}, w AS (SELECT unnest(regexp_extract_all(lower(title || ' ' || summary), '[\\p{{L}}\\p{{N}}_]+')) AS keyword FROM ent)
SELECT keyword, count(*) AS count FROM w WHERE regexp_full_match(keyword, '[a-z]+') AND length(keyword) >= 4 AND keyword NOT IN ({", ".join(f"'{x}'" for x in facets.STOP_WORDS)}) GROUP BY keyword ORDER BY count DESC, keyword LIMIT 20""")
def top_keywords(spark, d):
    return facets.top_keywords(entries(spark, d), "title", "summary")


@query("feed_activity", f"""WITH {_ENTRY}, p AS (SELECT unnest([{{'dimension': 'feed', 'value': feed_url}}, {{'dimension': 'domain', 'value': domain}}, {{'dimension': 'day', 'value': substring(published, 1, 10)}}]) AS p FROM ent),
c AS (SELECT p.dimension AS dimension, p.value AS value, count(*) AS count FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY value DESC) AS k FROM c)
SELECT dimension, value, count FROM r WHERE dimension <> 'day' OR k <= 30""")
def feed_activity(spark, d):
    return facets.activity(entries(spark, d))


@query("feed_distribution", f"WITH {_ENTRY} SELECT count(*) AS total_entries, count(DISTINCT feed_url) AS unique_feed_url, count(DISTINCT domain) AS unique_domain, count(DISTINCT author) AS unique_author FROM ent")
def feed_distribution(spark, d):
    return facets.distribution(entries(spark, d), "feed_url", "domain", "author")


@query("feed_status_counts", "SELECT count(*) FILTER (WHERE event_id % 6 IN (0, 1, 2)) AS valid, count(*) FILTER (WHERE event_id % 6 = 3) AS invalid, count(*) FILTER (WHERE event_id % 10 = 0) AS redirected, count(*) FILTER (WHERE event_id % 6 = 5) AS unreachable FROM events")
def feed_status_counts(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select(F.when(e % 6 < 3, 200).when(e % 6 == 3, 404).when(e % 6 == 4, 301).alias("status"), (e % 10 == 0).alias("redirected"))
    return facets.feed_status(rows)


@query("runtime_statistics", """SELECT event_type, count(*) AS count, round(sum(value) / count(value), 2) AS avg_ms, round(count(*) FILTER (WHERE event_id % 3 = 0) / CAST(count(*) AS DOUBLE), 3) AS cache_hit_rate FROM events GROUP BY event_type""")
def runtime_statistics(spark, d):
    return facets.runtime_statistics(table(spark, d, "events").withColumn("hit", F.col("event_id") % 3 == 0), "event_type", "value", "hit")


@query("feed_filters", f"WITH {_ENTRY} SELECT pos FROM ent WHERE contains(lower(author), 'news') AND contains(lower(title || ' ' || summary), 'the') AND strptime(published, '%Y-%m-%dT%H:%M:%SZ') BETWEEN TIMESTAMP '2023-12-01' AND TIMESTAMP '2024-02-20' AND (epoch(TIMESTAMP '{NOW_TEXT}') - epoch(strptime(published, '%Y-%m-%dT%H:%M:%SZ'))) / 86400 <= 80")
def feed_filters(spark, d):
    rows = feeds.by_keyword(feeds.by_author(entries(spark, d), "News"), "THE", "title", "summary")
    return feeds.by_date(rows, dates.parse(F.col("published")), now(), 80, "2023-12-01", "2024-02-20").select("pos")


def _rank_sql(required: tuple[str, ...], phrases: tuple[str, ...], excluded: tuple[str, ...]) -> str:
    flat = lambda c: rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"
    fields = {c: flat(c) for c in ("title", "summary", "author", "url", "domain")}
    combined = " || ' ' || ".join(fields[c] for c in ("title", "summary", "author", "url", "domain")) + " || ' '"
    parts = []
    for p in phrases:
        a = f"CASE WHEN contains(title, '{p}') THEN 40.0 ELSE 0 END + CASE WHEN contains(summary, '{p}') THEN 20.0 ELSE 0 END"
        parts.append(f"CASE WHEN ({a}) > 0 THEN {a} WHEN contains(combined, '{p}') THEN 10.0 ELSE 0 END")
    for w in required:
        a = " + ".join(f"{v} * {count_sql(c, w)}" for c, v in feeds.FIELD_WEIGHTS.items() if c != "content")
        parts.append(f"CASE WHEN ({a}) > 0 THEN {a} WHEN contains(replace(combined, ' ', ''), '{w}') THEN 3.0 ELSE 0 END")
    every = " AND ".join(f"contains(combined, '{w}')" for w in required)
    keep = " AND ".join([f"contains(replace(combined, ' ', ''), '{w}')" for w in required] + [f"NOT contains(combined, '{w}')" for w in excluded])
    score = " + ".join(parts)
    return f"""WITH {_ENTRY}, f AS (SELECT pos, published, {", ".join(f"{v} AS {c}" for c, v in fields.items())}, {combined} AS combined FROM ent),
s AS (SELECT pos, {score} + CASE WHEN {every} THEN 15.0 ELSE 0 END + greatest(0.0, 60 - 1.2 * greatest((epoch(TIMESTAMP '{NOW_TEXT}') - epoch(strptime(published, '%Y-%m-%dT%H:%M:%SZ'))) / 86400.0, 0)) AS score FROM f WHERE {keep})
SELECT pos, round(CAST(score AS DOUBLE), 6) AS score, round(CAST(least(1.0, score / 200) AS DOUBLE), 6) AS confidence FROM s WHERE score > 0"""


@query("feed_ranking", _rank_sql(("from", "the"), ("of the",), ("onth",)))
def feed_ranking(spark, d):
    rows = feeds.rank(entries(spark, d), 'from the "of the" -onth', dates.parse(F.col("published")), now())
    return rows.select("pos", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@query("first_wins_by_url", "SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_replace(trim(split_part(url, '?', 1)), '/+$', '') ORDER BY page_id) AS k FROM pages) WHERE k = 1")
def first_wins_by_url(spark, d):
    rows = table(spark, d, "pages")
    return dedup.first_wins(rows, dedup.url_key(F.split("url", r"\?")[0]), "page_id").select("page_id")


@query("first_wins_by_content", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(substring(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 5000)) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_wins_by_content(spark, d):
    return dedup.by_content(table(spark, d, "documents"), "text", "doc_id").select("doc_id")


_TITLE_KEY = r"trim(regexp_replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("similar_titles", rf"""WITH {CAND}, t AS (SELECT min(pos) AS pos, {_TITLE_KEY} AS k FROM cand GROUP BY k HAVING k <> ''), w AS (SELECT pos, list_distinct(string_split(k, ' ')) AS ws FROM t)
SELECT a.pos AS earlier, b.pos AS later FROM w a JOIN w b ON a.pos < b.pos AND list_has_any(a.ws, b.ws) WHERE len(list_intersect(a.ws, b.ws)) > 0.6 * len(list_distinct(list_concat(a.ws, b.ws)))""")
def similar_titles(spark, d):
    rows = candidates(spark, d).select("pos", dedup.title_key(F.col("title")).alias("k"))
    once = dedup.first_wins(rows, F.col("k"), "pos")
    return dedup.similar_title_pairs(once, "k", "pos", 0.6)


@query(
    "deduplicated_entries",
    rf"""WITH RECURSIVE {_ENTRY}, h AS (SELECT *, row_number() OVER (PARTITION BY sha256('|' || lower(trim(url)) || '|' || lower(trim(coalesce(title, '')))) ORDER BY pos) AS k FROM ent),
t AS (SELECT pos, trim(regexp_replace(regexp_replace(lower(trim(coalesce(title, ''))), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM h WHERE k = 1),
u AS (SELECT pos, key, list_distinct(string_split(key, ' ')) AS ws, row_number() OVER (PARTITION BY key ORDER BY pos) AS k FROM t WHERE key <> ''),
w AS (SELECT pos, len(ws) AS n, unnest(ws) AS word FROM u WHERE k = 1),
p AS (SELECT a.pos AS earlier, b.pos AS later FROM w a JOIN w b ON a.word = b.word AND a.pos < b.pos GROUP BY a.pos, b.pos, a.n, b.n HAVING count(*) > 0.9 * (a.n + b.n - count(*))),
o AS (SELECT later, list(earlier) AS es, row_number() OVER (ORDER BY later) AS k FROM p GROUP BY later),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT r.k + 1, CASE WHEN len(list_filter(es, lambda e: NOT list_contains(gone, e))) > 0 THEN list_append(gone, later) ELSE gone END FROM r JOIN o ON o.k = r.k + 1),
g AS (SELECT gone FROM r ORDER BY k DESC LIMIT 1)
SELECT pos FROM u WHERE k = 1 AND NOT list_contains((SELECT gone FROM g), pos) UNION ALL SELECT pos FROM t WHERE key = ''""",
)
def deduplicated_entries(spark, d):
    return dedup.entries(entries(spark, d)).select("pos")


@query("exact_shingle_pairs", rf"""WITH {CAND}, f AS (SELECT min(pos) AS pos, s FROM (SELECT pos, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM
 (SELECT pos, regexp_extract_all(lower(concat_ws(' ', trim(title), replace(regexp_extract(url, '^https?://([^/]+)', 1), 'www.', ''), substring(content, 1, 500))), '[\p{{L}}\p{{N}}_]+') AS w FROM cand)) WHERE len(s) > 0 GROUP BY s)
SELECT a.pos AS a, b.pos AS b, round(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard FROM f a JOIN f b ON a.pos < b.pos AND list_has_any(a.s, b.s)
WHERE len(list_intersect(a.s, b.s)) >= 0.5 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))""")
def exact_shingle_pairs(spark, d):
    rows = candidates(spark, d).withColumn("s", F.array_sort(dedup.shingles(dedup.fingerprint_text(F.col("title"), F.col("url"), F.col("content")))))
    once = rows.groupBy("s").agg(F.min("pos").alias("pos"))
    return dedup.near_pairs(once, "pos", "s").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


# ------------------------------------------------------------------ URLs, HTML
_TRACK = "|".join(urls.TRACKING)


@query("url_hosts", f"SELECT page_id, {host_sql('url')} AS host FROM pages")
def url_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query("normalized_urls", rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS base, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
 list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]+=.+') AND NOT regexp_matches(x, '^({_TRACK})=')) AS ps FROM pages),
f AS (SELECT page_id, path, base || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS whole FROM p)
SELECT page_id, CASE WHEN ends_with(whole, '/') AND length(path) > 1 THEN regexp_replace(whole, '/+$', '') ELSE whole END AS normal_url FROM f""")
def normalized_urls(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize(F.col("url")).alias("normal_url"))


@query("cache_keys", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS base, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
 list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^page=.+'))) AS ps FROM pages), f AS (SELECT page_id, path, base || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS whole FROM p)
SELECT page_id, substring(sha256(CASE WHEN ends_with(whole, '/') AND length(path) > 1 THEN regexp_replace(whole, '/+$', '') ELSE whole END), 1, 32) AS cache_key FROM f""")
def cache_keys(spark, d):
    return table(spark, d, "pages").select("page_id", urls.cache_key(F.col("url"), ("page",)).alias("cache_key"))


@query("url_variants", r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '/+$', '') AS base, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END AS j FROM pages),
v AS (SELECT page_id, unnest([{'rung': 'amp_path', 'url': base || '/amp'}, {'rung': 'amp_query', 'url': url || j || 'amp=1'}, {'rung': 'mobile', 'url': regexp_extract(url, '^([a-z]+)://', 1) || '://m.' || regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^(www|m)\.', '') || regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)},
 {'rung': 'print_query', 'url': url || j || 'print=1'}, {'rung': 'print_path', 'url': base || '/print'}]) AS v FROM p) SELECT page_id, v.rung AS rung, v.url AS url FROM v""")
def url_variants(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(urls.variants(F.col("url"))).alias("v")).select("page_id", "v.rung", "v.url")


_WRAPPED = (
    "'https://news.google.com/rss/articles/' || page_id", "'https://www.msn.com/en-us/x?url=https%3A%2F%2Fpub.example%2Fa%2F' || page_id || '&k=1'", "'https://news.google.com/c/' || page_id", "url", "'https://www.msn.com/o/' || page_id",
)
_HEADS = ("''", "''", "'<link rel=\"canonical\" href=\"https://canon.example/' || page_id || '\">'", "''", "'<meta property=\"og:url\" content=\"https://og.example/' || page_id || '\">'")


@query(
    "resolved_urls",
    f"""SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'https://pub.example/a/' || page_id WHEN 2 THEN 'https://canon.example/' || page_id WHEN 4 THEN 'https://og.example/' || page_id END AS publisher_url, CASE WHEN page_id % 5 = 3 THEN 1.0 ELSE 0.25 END AS multiplier FROM pages""",
)
def resolved_urls(spark, d):
    pick = lambda values: F.element_at(F.array(*[F.expr(v) for v in values]), (F.col("page_id") % 5 + 1).cast("int"))
    p = table(spark, d, "pages").select("page_id", pick(_WRAPPED).alias("url"), F.concat(F.lit("<html><head>"), pick(_HEADS), F.lit("</head></html>")).alias("html"))
    return p.select("page_id", urls.resolve(F.col("url"), F.col("html")).alias("publisher_url"), urls.ranking_multiplier(F.col("url"), F.lit(False)).alias("multiplier"))


def _unescape_sql(text: str) -> str:
    for a, b in html.ENTITIES:
        text = f"replace({text}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return text


@query("page_titles", rf"SELECT page_id, trim(regexp_replace({_unescape_sql(chr(34) + 't' + chr(34))}, '\s+', ' ', 'g')) AS title FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("page_text", rf"""SELECT page_id, sha256(trim(regexp_replace({_unescape_sql('t')}, '\s+', ' ', 'g'))) AS text_sha256 FROM
 (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages)""")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(html.strip_tags(F.col("html")), 256).alias("text_sha256"))


@query(
    "page_descriptions",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'About ' || page_id || ' & more' WHEN 1 THEN 'Open ' || page_id WHEN 2 THEN 'Short ' || page_id ELSE '' END AS description FROM pages""",
)
def page_descriptions(spark, d):
    k = F.col("page_id").cast("string")
    tags = F.element_at(
        F.array(
            F.concat(F.lit('<meta name="description" content="About '), k, F.lit(' &amp; more"><meta property="og:description" content="no">')), F.concat(F.lit("<META property='og:description' content='Open "), k, F.lit("'>")),
            F.concat(F.lit('<meta name="twitter:description" content=" Short '), k, F.lit(' ">')), F.lit('<meta name="keywords" content="none">'),
        ),
        (F.col("page_id") % 4 + 1).cast("int"),
    )
    return table(spark, d, "pages").select("page_id", html.meta_description(F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), tags))).alias("description"))


@query("page_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"''#]+)', 1)) AS link FROM pages) SELECT DISTINCT page_id, link FROM l""")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(graph.links(F.col("html"))).alias("link"))


@query("page_content")
def page_content(spark, d):
    return table(spark, d, "pages").select("page_id", html.extract_content(F.col("html")).alias("c")).select("page_id", F.length("c.text").alias("n_chars"), "c.confidence")


@query("unescaped_nfkc", """SELECT doc_id, sha256('a & <b> fi 1⁄2 é 2 ' || text) AS text_sha256 FROM documents""")
def unescaped_nfkc(spark, d):
    odd = F.concat(F.lit("a &amp; &lt;b&gt; ﬁ ½ e\u0301 ² "), "text")
    return table(spark, d, "documents").select("doc_id", F.sha2(html.unescape_nfkc(odd), 256).alias("text_sha256"))


@query(
    "parsed_feeds",
    r"""SELECT conv_id, CAST(turn AS BIGINT) AS turn, 'https://example.org/' || turn AS url, trim(regexp_replace(substring(text, 1, 80), '\s+', ' ', 'g')) AS title, '2024-03-' || lpad(CAST(1 + turn % 28 AS VARCHAR), 2, '0') || 'T10:00:00+00:00' AS published FROM conversations""",
)
def parsed_feeds(spark, d):
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.date_format(F.make_date(F.lit(2024), F.lit(3), (1 + F.col("turn") % 28).cast("int")), "EEE, dd MMM yyyy")
    item = F.concat(F.lit("<item><title>"), esc(F.substring("text", 1, 80)), F.lit("</title><link>https://example.org/"), F.col("turn").cast("string"), F.lit("</link><pubDate>"), day, F.lit(" 10:00:00 GMT</pubDate></item>"))
    xml = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    parsed = feeds.normalize(feeds.parse(xml.withColumnRenamed("conv_id", "feed_url")))
    return parsed.select(F.col("feed_url").cast("long").alias("conv_id"), F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("turn"), "url", "title", "published")


@query("parsed_feeds", """WITH c AS (SELECT conv_id, count(*) AS entries FROM conversations GROUP BY conv_id) SELECT conv_id, entries FROM c""")
def parsed_feeds(spark, d):
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(F.lit("<item><title>"), esc(F.substring("text", 1, 80)), F.lit("</title><link>https://example.org/"), F.col("turn").cast("string"), F.lit("</link><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate></item>"))
    xml = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    parsed = feeds.normalize(feeds.parse(xml.withColumnRenamed("conv_id", "feed_url")))
    return parsed.where(F.col("published") == "2024-03-01T10:00:00+00:00").groupBy(F.col("feed_url").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("entries"))


@query("unified_records", f"WITH {CAND} SELECT url AS id, source, url, title, snippet, content_type, publish_date AS timestamp, lang FROM cand")
def unified_records(spark, d):
    return ingest.unified(candidates(spark, d)).select("id", "source", "url", "title", "snippet", "content_type", "timestamp", "lang")


