"""Queries on payload readers: pages and responses made of the tables' rows, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html
from ..operators import acquisition, documents, feeds, ingest, quality
from ..sources import payloads, sinks
from .common import CAND, candidates, now, query, table


def _as_json(rows, value, *keys, order="n"):
    """(keys, payload): an array of ``value`` in order, as JSON."""
    return rows.groupBy(*keys).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"])).alias("payload"))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _s(c):
    return F.col(c).cast("string")


# ---------------------------------------------------------------- repositories
@query(
    "repository_facts",
    """SELECT p_partkey, 'owner' || p_size || '/' || p_partkey AS full_name, p_name AS description, CAST(p_size AS BIGINT) AS stars, CAST(p_partkey AS BIGINT) AS forks, CASE WHEN p_partkey % 3 = 0 THEN 'MIT' END AS license, p_partkey % 2 = 0 AS is_fork, p_brand AS topics FROM part""",
)
def repository_facts(spark, d):
    body = F.to_json(F.struct(
        F.concat(F.lit("owner"), _s("p_size"), F.lit("/"), _s("p_partkey")).alias("full_name"), F.col("p_name").alias("description"), F.col("p_size").alias("stargazers_count"), F.col("p_partkey").alias("forks_count"),
        F.when(F.col("p_partkey") % 3 == 0, F.struct(F.lit("MIT").alias("spdx_id"))).alias("license"), (F.col("p_partkey") % 2 == 0).alias("fork"), F.array("p_brand").alias("topics"),
    ))
    rows = payloads.repositories(table(spark, d, "part").select("p_partkey", body.alias("payload")), "payload", "p_partkey")
    return rows.select("p_partkey", "full_name", "description", "stars", "forks", "license", "is_fork", F.array_join("topics", ",").alias("topics"))


@query(
    "issue_rows",
    """SELECT conv_id, CAST(turn AS BIGINT) AS number, substring(text, 1, 60) AS title, role AS author, CASE WHEN turn % 2 = 0 THEN 'bug,' || role ELSE '' END AS labels, turn % 3 = 0 AS is_pull_request FROM conversations""",
)
def issue_rows(spark, d):
    label = lambda c: F.struct(c.alias("name"))
    issue = F.struct(
        F.col("turn").alias("number"), F.substring("text", 1, 60).alias("title"), F.struct(F.col("role").alias("login")).alias("user"),
        F.when(F.col("turn") % 2 == 0, F.array(label(F.lit("bug")), label(F.col("role")))).otherwise(F.array().cast("array<struct<name:string>>")).alias("labels"), F.when(F.col("turn") % 3 == 0, F.struct(F.lit("x").alias("url"))).alias("pull_request"),
    )
    rows = payloads.issues(_as_json(table(spark, d, "conversations").withColumn("n", F.col("turn")), issue, "conv_id"), "payload", "conv_id", pull_requests=True)
    return rows.select("conv_id", "number", "title", "author", F.array_join("labels", ",").alias("labels"), "is_pull_request")


@query("commit_rows", """SELECT conv_id, CAST(turn AS VARCHAR) AS sha, string_split(text, chr(10))[1] AS title, role AS author, CAST(length(text) AS BIGINT) AS comment_count FROM conversations""")
def commit_rows(spark, d):
    commit = F.struct(_s("turn").alias("sha"), F.struct(F.col("text").alias("message"), F.struct(F.col("role").alias("name")).alias("author"), F.length("text").alias("comment_count")).alias("commit"))
    return payloads.commits(_as_json(table(spark, d, "conversations").withColumn("n", F.col("turn")), commit, "conv_id"), "payload", "conv_id").select("conv_id", "sha", "title", "author", "comment_count")


@query("pagination_counts", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderkey % 1000 AS INTEGER) END AS pages FROM orders""")
def pagination_counts(spark, d):
    last = F.concat(F.lit('<https://api/x?per_page=1&page='), (F.col("o_orderkey") % 1000).cast("string"), F.lit('>; rel="last"'))
    header = F.when(F.col("o_orderkey") % 4 == 3, F.lit('<https://api/x?page=2>; rel="next"')).otherwise(F.concat(F.lit('<https://api/x?page=2>; rel="next", '), last))
    return table(spark, d, "orders").select("o_orderkey", payloads.last_page(header).alias("pages"))


# ---------------------------------------------------------------------- social
@query(
    "chat_messages",
    """SELECT conv_id, conv_id * 1000 + turn AS id, role AS author, CASE WHEN turn % 4 = 0 THEN 'Card ' || turn || chr(10) || 'about ' || role ELSE substring(text, 1, 200) END AS content, CAST(CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END AS BIGINT) AS reactions FROM conversations WHERE turn % 4 = 0 OR text <> ''""",
)
def chat_messages(spark, d):
    card = F.col("turn") % 4 == 0
    embed = F.struct(F.concat(F.lit("Card "), _s("turn")).alias("title"), F.concat(F.lit("about "), "role").alias("description"))
    message = F.struct(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), F.when(card, "").otherwise(F.substring("text", 1, 200)).alias("content"), F.struct(F.col("role").alias("username")).alias("author"),
        F.when(card, F.array(embed)).otherwise(F.array().cast("array<struct<title:string,description:string>>")).alias("embeds"),
        F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.struct(F.lit("ok").alias("name")).alias("emoji"), F.col("turn").cast("long").alias("count")))).alias("reactions"),
    )
    rows = payloads.discord_messages(_as_json(table(spark, d, "conversations").withColumn("n", F.col("turn")), message, "conv_id"), "payload", "conv_id")
    return rows.where("content <> ''").select("conv_id", F.col("id").cast("long").alias("id"), "author", "content", F.coalesce(F.get("reactions", F.lit(0))["count"], F.lit(0)).alias("reactions"))


@query("older_messages", "SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS id FROM lineitem WHERE l_orderkey * 10 + l_linenumber < 5000 ORDER BY l_orderkey * 10 + l_linenumber DESC LIMIT 50")
def older_messages(spark, d):
    return payloads.page_before(table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("id")), "5000", 50)


@query(
    "channel_posts",
    r"""SELECT conv_id, 'c' || conv_id || '/' || turn AS id, CASE WHEN turn % 5 = 1 THEN 'photo' WHEN turn % 5 = 2 THEN 'poll' ELSE 'text' END AS type, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CAST(turn * 100 + 1200 AS BIGINT) AS views_count, turn % 2 = 1 AS edited
FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""",
)
def channel_posts(spark, d):
    mark = F.when(F.col("turn") % 5 == 1, '<a class="tgme_widget_message_photo_wrap"></a>').when(F.col("turn") % 5 == 2, '<div class="tgme_widget_message_poll"></div>').otherwise("")
    views = F.concat(F.format_string("%.1f", (F.col("turn") * 100 + 1200) / 1000), F.lit("K"))
    post = F.concat(
        F.lit('<div class="tgme_widget_message" data-post="c'), _s("conv_id"), F.lit("/"), _s("turn"), F.lit('"><div class="tgme_widget_message_text">'), _escaped(F.col("text")), F.lit("</div>"), mark,
        F.lit('<span class="tgme_widget_message_views">'), views, F.lit('</span><span class="tgme_widget_message_meta">'), F.when(F.col("turn") % 2 == 1, "Edited").otherwise("at"), F.lit("</span></div>"),
    )
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("<html>"), F.array_join(F.collect_list(post), ""), F.lit("</html>")).alias("html"))
    return payloads.telegram_posts(pages, "html", "conv_id").where("text <> ''").select("conv_id", "id", "type", "text", "views_count", "edited")


@query("missing_channels", "SELECT page_id, page_id % 4 IN (0, 1) AS not_found FROM pages")
def missing_channels(spark, d):
    page = F.element_at(F.array(*[F.lit(x) for x in ("<p>If you have <strong>Telegram</strong>, you can</p>", "<b>Channel NOT found</b>", '<div class="x tgme_channel_info_header_title">A</div> no posts', '<div class="tgme_widget_message_wrap">if you have <strong>telegram</strong></div>')]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", payloads.looks_not_found(page).alias("not_found"))


@query(
    "chosen_capabilities",
    """WITH r AS (SELECT c_custkey, (['discord', 'instagram', 'reddit', 'telegram', 'nowhere'])[c_custkey % 5 + 1] AS platform, c_custkey % 2 = 0 AS ch, c_custkey % 3 = 0 AS us, c_custkey % 7 <> 0 AS q FROM customer)
SELECT c_custkey, CASE platform WHEN 'reddit' THEN CASE WHEN us THEN 'user' WHEN q THEN 'query' END WHEN 'telegram' THEN CASE WHEN ch THEN 'channel' WHEN q THEN 'query' END WHEN 'nowhere' THEN NULL ELSE CASE WHEN q THEN 'query' END END AS capability,
 CASE WHEN platform = 'nowhere' THEN 'unknown_platform' WHEN NOT q AND NOT (platform = 'reddit' AND us) AND NOT (platform = 'telegram' AND ch) THEN 'no_input' END AS error FROM r""",
)
def chosen_capabilities(spark, d):
    k = F.col("c_custkey")
    platform = F.element_at(F.array(*[F.lit(x) for x in ("discord", "instagram", "reddit", "telegram", "nowhere")]), (k % 5 + 1).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", platform.alias("platform"), F.when(k % 2 == 0, "c").alias("channel"), F.when(k % 3 == 0, "u").alias("user"), F.when(k % 7 != 0, "q").otherwise("").alias("query"))
    return payloads.chosen_capability(rows).select("c_custkey", "capability", "error")


@query(
    "profile_posts",
    """SELECT doc_id, source AS author, text AS content, 'https://i.example/' || doc_id AS url, lang AS title FROM documents WHERE text <> '' AND lang IS NOT NULL""",
)
def profile_posts(spark, d):
    post = F.struct(F.lit("BlogPosting").alias("@type"), F.col("text").alias("articleBody"), F.struct(F.col("source").alias("name")).alias("author"), F.struct(F.concat(F.lit("https://i.example/"), _s("doc_id")).alias("@id")).alias("mainEntityOfPage"), F.col("lang").alias("headline"))
    block = F.to_json(F.struct(F.array(post, F.struct(F.lit("Person").alias("@type"), *[F.lit(None).cast(t).alias(n) for n, t in (("articleBody", "string"), ("author", "struct<name:string>"), ("mainEntityOfPage", "struct<`@id`:string>"), ("headline", "string"))])).alias("@graph")))
    rows = table(spark, d, "documents").where("text <> '' AND lang IS NOT NULL").select("doc_id", F.concat(F.lit('<script type="application/ld+json">'), F.replace(block, F.lit("</"), F.lit("<\\/")), F.lit("</script>")).alias("html"))
    return payloads.instagram_posts(rows, "html", "doc_id").select("doc_id", "author", "content", "url", "title")


# ------------------------------------------------------------------ wiki, media
@query(
    "wiki_extracts",
    r"""SELECT doc_id AS pageid, 'Page ' || doc_id AS title, trim(regexp_replace(text, '\s+', ' ', 'g')) AS extract, 'L' || (doc_id % 9) || ',M' AS links, 'Category:' || source AS categories FROM documents WHERE text IS NOT NULL""",
)
def wiki_extracts(spark, d):
    named = lambda *cs: F.array(*[F.struct(c.alias("title")) for c in cs])
    l = F.concat(F.lit("L"), (F.col("doc_id") % 9).cast("string"))
    page = F.struct(F.col("doc_id").alias("pageid"), F.concat(F.lit("Page "), _s("doc_id")).alias("title"), F.col("text").alias("extract"), named(l, F.lit("User:X"), F.lit("M"), l, F.lit("Template:T")).alias("links"), named(F.concat(F.lit("Category:"), "source")).alias("categories"))
    body = F.to_json(F.struct(F.struct(F.create_map(_s("doc_id"), page).alias("pages")).alias("query")))
    rows = payloads.wiki_pages(table(spark, d, "documents").where("text IS NOT NULL").select(body.alias("payload")))
    return rows.select("pageid", "title", "extract", F.array_join("links", ",").alias("links"), F.array_join("categories", ",").alias("categories"))


@query(
    "wiki_changes",
    """WITH c AS (SELECT conv_id, turn, 'Art ' || (turn // 2) AS title, row_number() OVER (PARTITION BY 'Art ' || (turn // 2) ORDER BY 'f' || lpad(CAST(conv_id AS VARCHAR), 9, '0'), turn) AS k FROM conversations WHERE turn % 5 <> 4)
SELECT title, CASE WHEN turn % 2 = 0 THEN 'Lead ' || turn ELSE 'kept ' || conv_id END AS summary FROM c WHERE k = 1""",
)
def wiki_changes(spark, d):
    title = F.when(F.col("turn") % 5 == 4, F.lit("User:Someone")).otherwise(F.concat(F.lit("Art "), F.floor(F.col("turn") / 2).cast("string")))
    noted = F.concat(F.lit('<span class="autocomment">Lead '), _s("turn"), F.lit("</span><table><tr><td>d</td></tr></table>"))
    plain = F.concat(F.lit("<table><tr><td>gone</td></tr></table> kept <b>"), _s("conv_id"), F.lit("</b>"))
    feed = F.concat(F.lit("f"), F.lpad(_s("conv_id"), 9, "0"))
    return payloads.recent_changes(table(spark, d, "conversations").select(feed.alias("feed_url"), F.col("turn").alias("n"), title.alias("title"), F.when(F.col("turn") % 2 == 0, noted).otherwise(plain).alias("summary"))).select("title", "summary")


@query(
    "video_nodes",
    """SELECT p_partkey, 'v' || p_partkey AS video_id, p_name AS title, p_brand AS channel, 'https://www.youtube.com/watch?v=v' || p_partkey AS url FROM part""",
)
def video_nodes(spark, d):
    video = F.struct(F.concat(F.lit("v"), _s("p_partkey")).alias("videoId"), F.struct(F.array(F.struct(F.col("p_name").alias("text"))).alias("runs")).alias("title"), F.struct(F.col("p_brand").alias("simpleText")).alias("ownerText"))
    node = F.struct(video.alias("videoRenderer"))
    data = F.to_json(F.struct(F.array(F.struct(F.array(node, node).alias("items"))).alias("contents")))
    pages = table(spark, d, "part").select("p_partkey", F.concat(F.lit("<script>var ytInitialData = "), data, F.lit(";</script>")).alias("html"))
    return payloads.videos(pages, "html", "p_partkey").select("p_partkey", "video_id", "title", "channel", "url")


@query(
    "media_entries",
    """SELECT conv_id, CAST(turn AS INTEGER) AS turn, 'https://m.example/' || turn || '.jpg' AS media_url, CAST(100 * turn AS INTEGER) AS width FROM conversations WHERE turn % 3 <> 2 AND 100 * turn >= 200""",
)
def media_entries(spark, d):
    tag = F.when(F.col("turn") % 3 == 2, "").otherwise(F.concat(F.lit('<media:content url="https://m.example/'), _s("turn"), F.lit('.jpg" width="'), (100 * F.col("turn")).cast("string"), F.lit('" height="50"/>')))
    item = F.concat(F.lit("<item><title>T</title><link>https://m.example/p/"), _s("turn"), F.lit("</link>"), tag, F.lit("</item>"))
    feed = table(spark, d, "conversations").groupBy(_s("conv_id").alias("feed_url")).agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list(item), ""), F.lit("</rss>")).alias("xml"))
    rows = feeds.by_dimensions(feeds.media(feed), min_width=200)
    return rows.select(F.col("feed_url").cast("long").alias("conv_id"), F.regexp_extract("link", r"(\d+)$", 1).cast("int").alias("turn"), "media_url", "width")


@query(
    "tag_feeds",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'animegirls anime animemanga swords' WHEN 1 THEN 'digitalart traditional painting' WHEN 2 THEN 'quietlake' WHEN 3 THEN '' ELSE 'naturephotography photography' END AS tags FROM part""",
)
def tag_feeds(spark, d):
    q = F.element_at(F.array(*[F.lit(x) for x in ("Anime Girls sword anime", "digital art", "quiet lake", "  ", "nature photography")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    urls = F.transform(feeds.tag_feeds(q), lambda u: F.regexp_extract(u, r"^https://backend\.deviantart\.com/rss\.xml\?q=([^&]+)&type=deviation$", 1))
    return table(spark, d, "part").select("p_partkey", F.array_join(urls, " ").alias("tags"))


# --------------------------------------------------------------- pages, records
@query(
    "result_links",
    """SELECT page_id, CAST(0 AS INTEGER) AS n, 'Title ' || page_id || ' & more' AS title, 'https://x.example/a/' || page_id AS href, 'Body of ' || page_id AS body FROM pages UNION ALL SELECT page_id, 1, 'Second', 'https://y.example/' || page_id, 'end' FROM pages""",
)
def result_links(spark, d):
    k = _s("page_id")
    page = F.concat(
        F.lit('<a class="r" href="https://d.example/l/?uddg=https%3A%2F%2Fx.example%2Fa%2F'), k, F.lit('">Title <b>'), k, F.lit("</b> &amp; more</a><span>Body of "), k, F.lit('</span><a href="https://y.example/'), k, F.lit('">Second</a> end <a href="/next">n</a>'),
    )
    return payloads.result_page(table(spark, d, "pages").select("page_id", page.alias("html")), "html", "page_id").select("page_id", "n", "title", "href", "body")


@query(
    "publisher_titles",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'News - of ' || c_custkey WHEN 1 THEN 'News & ' || c_custkey WHEN 2 THEN 'News of ' || c_custkey || ' - TOI' ELSE 'News of ' || c_custkey END AS generic,
 CASE c_custkey % 4 WHEN 0 THEN 'News' WHEN 1 THEN 'News & ' || c_custkey ELSE 'News of ' || c_custkey END AS google FROM customer""",
)
def publisher_titles(spark, d):
    k, n = F.col("c_custkey") % 4, _s("c_custkey")
    title = F.when(k == 0, F.concat(F.lit("News - of "), n)).when(k == 1, F.concat(F.lit("News &amp; <b>"), n, F.lit("</b>"))).when(k == 2, F.concat(F.lit("News of "), n, F.lit(" - TOI"))).otherwise(F.concat(F.lit("News of "), n, F.lit("  - Times of INDIA ")))
    paper = F.when(k == 3, "Times of India").otherwise("Another")
    return table(spark, d, "customer").select("c_custkey", payloads.publisher_title(title, paper).alias("generic"), payloads.publisher_title(title, paper, "google_news").alias("google"))


@query(
    "news_descriptions",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://p.example/' || c_custkey END AS link, CASE c_custkey % 3 WHEN 0 THEN 'Story ' || c_custkey WHEN 1 THEN 'only words' ELSE 'a' END AS text,
 CASE c_custkey % 3 WHEN 0 THEN 'Paper & Co' WHEN 1 THEN '' ELSE 'Src' END AS source, CASE c_custkey % 3 WHEN 0 THEN 'https://p.example/' || c_custkey WHEN 1 THEN 'https://q.example/a b' ELSE 'https://news.google.com/articles/' || c_custkey END AS url FROM customer""",
)
def news_descriptions(spark, d):
    k, n = F.col("c_custkey") % 3, _s("c_custkey")
    html_part = F.when(k == 0, F.concat(F.lit('<a target="_blank" href="https://p.example/'), n, F.lit('">Story <i>'), n, F.lit('</i></a><font size="-1">Paper &amp; Co</font>'))).when(k == 1, F.lit(" only <b>words</b> ")).otherwise(F.lit('a<source url="https://s.example">Src</source>'))
    url = F.when(k == 1, F.lit("https://news.google.com/x?q=https://q.example/a%20b&hl=en")).otherwise(F.concat(F.lit("https://news.google.com/articles/"), n))
    rows = table(spark, d, "customer").select("c_custkey", url.alias("raw"), F.explode(F.array(payloads.description_parts(html_part))).alias("p"))
    text = F.regexp_replace("p.text", " Src$", "")
    return rows.select("c_custkey", "p.link", text.alias("text"), "p.source", payloads.news_url(F.col("raw"), F.col("p.link")).alias("url"))


@query(
    "enriched_entries",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'feeds.example.org' WHEN 1 THEN 'tech.example.com' WHEN 2 THEN 'techcrunch' ELSE 'a.example' END AS feed_name,
 CASE p_partkey % 4 WHEN 0 THEN 'ai' WHEN 1 THEN 'odd-topic' WHEN 2 THEN 'all' ELSE 'cryptocurrency' END AS category, '2024-03-02T00:00:00+00:00' AS fetched_at FROM part""",
)
def enriched_entries(spark, d):
    k = F.col("p_partkey") % 4
    url = F.when(k == 0, "https://www.feeds.example.org/category/Machine-Learning/feed/").when(k == 1, "https://tech.example.com/tag/odd-topic/feed").when(k == 2, "no address").otherwise("https://a.example/tag/x")
    asked = F.when(k == 3, " Crypto ").when(k == 1, "no such")
    rows = feeds.enrich(table(spark, d, "part").select("p_partkey", url.alias("feed_url"), asked.alias("asked")), now(), asked="asked")
    return rows.select("p_partkey", "feed_name", "category", "fetched_at")


@query(
    "location_news",
    """WITH f AS (SELECT * FROM (VALUES (0, 'toi-us', 'us1'), (1, 'toi-us', 'us2'), (2, 'toi-india-delhi', 'dl')) v(k, source, name)), e AS (SELECT k, source, name, n FROM f CROSS JOIN range(8) t(n) WHERE n <> 2),
u AS (SELECT source, k, n, CASE WHEN n = 0 THEN 'https://n.example/shared' ELSE 'https://n.example/' || name || '/' || n END AS url FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY k, n) AS turn FROM u),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS place FROM o WHERE turn = 1) SELECT source, CAST(n AS INTEGER) AS n, url, 'body ' || n AS body FROM c WHERE place <= 5""",
)
def location_news(spark, d):
    item = lambda name, n: f"<item><title>{'' if n == 2 else 'T'}</title><link>https://n.example/{'shared' if n == 0 else f'{name}/{n}'}</link><description>&lt;a&gt;body&lt;/a&gt; {n}</description></item>"
    names = dict(zip(("us1", "us2", "dl"), [*feeds.LOCATION_FEEDS["us"], *feeds.LOCATION_FEEDS["india-delhi"]], strict=True))
    landed = spark.createDataFrame([(url, "<rss>" + "".join(item(name, n) for n in range(8)) + "</rss>") for name, url in names.items()], "feed_url string, xml string")
    requests = spark.createDataFrame([(0, "US"), (1, " India Delhi"), (2, "nowhere")], "pos int, location string")
    return feeds.location_news(requests, landed).select("source", "n", "url", "body")


# ----------------------------------------------------------------- acquisition
@query(
    "polite_turns",
    """WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 50 AS host, CAST(l_orderkey % 40 AS DOUBLE) AS asked FROM lineitem WHERE l_suppkey % 10 = 3),
o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY asked, l_orderkey * 10 + l_linenumber) AS k FROM r),
s AS (SELECT host, k, l_orderkey, l_linenumber, asked AS start FROM o WHERE k = 1 UNION ALL SELECT o.host, o.k, o.l_orderkey, o.l_linenumber, greatest(o.asked, s.start + 1.5) FROM s JOIN o ON o.host = s.host AND o.k = s.k + 1)
SELECT l_orderkey, l_linenumber, start FROM s""",
)
def polite_turns(spark, d):
    rows = table(spark, d, "lineitem").where("l_suppkey % 10 = 3").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50).alias("host"), (F.col("l_orderkey") % 40).cast("double").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return acquisition.turns(rows, delay=1.5).select("l_orderkey", "l_linenumber", "start")


@query(
    "available_proxies",
    """WITH p AS (SELECT DISTINCT 'h' || (user_id % 30) || ':80' AS proxy_id FROM events), l AS (SELECT 'h' || (user_id % 23) || ':80' AS proxy_id, arg_max(event_id % 3 <> 0, ts) AS ok, max(ts) AS ts FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT proxy_id FROM p LEFT JOIN l USING (proxy_id) CROSS JOIN n WHERE coalesce(ok OR epoch(now) - epoch(ts) >= 3600, true) UNION ALL SELECT 'direct'""",
)
def available_proxies(spark, d):
    e = table(spark, d, "events")
    latest = e.agg(F.max("ts")).first()[0]
    log = e.select(F.concat(F.lit("h"), (F.col("user_id") % 23).cast("string"), F.lit(":80")).alias("proxy_id"), (F.col("event_id") % 3 != 0).alias("success"), "ts")
    proxies = e.select(F.concat(F.lit("http://user:secret@h"), (F.col("user_id") % 30).cast("string"), F.lit(":80")).alias("proxy"))
    return acquisition.proxies_available(proxies, log, F.lit(latest), 3600)


@query(
    "ladder_outcomes",
    """WITH r AS (SELECT l_orderkey AS url, l_linenumber - 1 AS k, (l_orderkey + l_linenumber) % 4 = 0 AS ok FROM lineitem WHERE l_linenumber <= 5), f AS (SELECT url, min(k) FILTER (WHERE ok) AS first FROM r GROUP BY url)
SELECT url, CASE WHEN first IS NULL THEN 'failed' ELSE 'success' END AS status, 'r' || first AS rung, string_agg('r' || k, ',' ORDER BY k) FILTER (WHERE first IS NULL OR k <= first) AS rungs_tried FROM r JOIN f USING (url) GROUP BY url, first""",
)
def ladder_outcomes(spark, d):
    k = F.col("l_linenumber") - 1
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("url"), k.alias("rung_order"), F.concat(F.lit("r"), k.cast("string")).alias("rung"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 4 == 0).alias("success"))
    return acquisition.ladder_outcomes(rows).withColumn("rungs_tried", F.array_join("rungs_tried", ","))


@query(
    "fetch_outcomes",
    """WITH r AS (SELECT l_orderkey AS url, l_linenumber - 1 AS k, (ARRAY[200, 503, 404, 429, 500])[(l_orderkey * 3 + l_linenumber) % 5 + 1] AS code, 'tier' || (l_linenumber % 3) AS tier FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
f AS (SELECT url, min(k) FILTER (WHERE code = 200) AS won, max(k) AS last, count(*) AS n FROM r GROUP BY url)
SELECT f.url, CASE WHEN won IS NOT NULL THEN 'success' WHEN code IN (429, 500, 503) THEN 'retry' ELSE 'failed' END AS status, CAST(CASE WHEN won IS NOT NULL THEN won + 1 ELSE n END AS INTEGER) AS attempts, tier,
 CASE WHEN won IS NULL THEN 'e' || code END AS error FROM f JOIN r ON r.url = f.url AND r.k = coalesce(won, last)""",
)
def fetch_outcomes(spark, d):
    code = F.element_at(F.array(*[F.lit(x) for x in (200, 503, 404, 429, 500)]), ((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 5 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").alias("url"), (F.col("l_linenumber") - 1).alias("attempt"), F.concat(F.lit("tier"), (F.col("l_linenumber") % 3).cast("string")).alias("tier"), code.alias("status_code"), F.concat(F.lit("e"), code.cast("string")).alias("error"))
    return acquisition.fetch_outcomes(rows)


@query("compacted_options", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a,b' ELSE 'a,c' END AS kept FROM nation")
def compacted_options(spark, d):
    k = F.col("n_nationkey") % 3
    options = F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.when(k == 1, "x").when(k == 0, "  "), F.lit("c"), F.when(k == 2, "y").otherwise(""))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(F.map_keys(acquisition.compacted(options)), ",").alias("kept"))


@query("parsed_sizes", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey * 1024 WHEN 2 THEN CAST((p_partkey + 0.5) * 1048576 AS BIGINT) WHEN 3 THEN p_partkey * 1073741824 END AS bytes FROM part""")
def parsed_sizes(spark, d):
    n = _s("p_partkey")
    text = F.element_at(F.array(F.concat(n, F.lit("b")), F.concat(n, F.lit(" KB")), F.concat(n, F.lit(".5mb")), F.concat(F.lit(" "), n, F.lit("GB ")), n, F.concat(n, F.lit("tb"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", documents.parse_size(text).alias("bytes"))


@query("markdown_rows", """SELECT '| ' || n_nationkey || ' | ' || n_name || ' | a' || chr(92) || '|b | |' AS line FROM nation""")
def markdown_rows(spark, d):
    return sinks.markdown_rows(table(spark, d, "nation").select("n_nationkey", "n_name", F.lit("a|b").alias("odd"), F.lit(None).cast("string").alias("none"))).select(F.regexp_replace("line", r" \|  \|$", " | |").alias("line"))


@query("yaml_rows", """SELECT '- key: ' || n_nationkey || chr(10) || '  name: "' || n_name || '"' || chr(10) || '  none: null' || chr(10) || '  list: ["a",' || '"b"]' AS line FROM nation""")
def yaml_rows(spark, d):
    return sinks.yaml_rows(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("none"), F.array(F.lit("a"), F.lit("b")).alias("list")))


@query(
    "newest_entries",
    f"WITH {CAND}, r AS (SELECT pos, CASE WHEN pos % 7 <> 0 THEN publish_date END AS dated, title FROM cand) SELECT pos FROM r ORDER BY dated IS NULL, dated DESC, lower(title), pos LIMIT 40",
)
def newest_entries(spark, d):
    rows = candidates(spark, d).withColumn("at", F.when(F.col("pos") % 7 != 0, F.to_timestamp("publish_date")))
    return feeds.sort_newest(rows.orderBy("pos"), F.col("at")).orderBy(F.col("at").isNull(), F.col("at").desc(), F.lower("title"), "pos").limit(40).select("pos")


@query("processed_results", f"WITH {CAND}, r AS (SELECT pos, CAST(pos % 11 AS DOUBLE) / 10 AS s FROM cand WHERE pos % 4 <> 1) SELECT pos FROM r ORDER BY s DESC, pos LIMIT 30")
def processed_results(spark, d):
    rows = candidates(spark, d).select("pos", F.col("pos").alias("position"), F.when(F.col("pos") % 4 == 1, "failed").otherwise("success").alias("extraction_status"), ((F.col("pos") % 11).cast("double") / 10).alias("content_quality_score"))
    return documents.process(rows).limit(30).select("pos")


@query("safe_names", r"""SELECT doc_id, substring(regexp_replace(regexp_replace(trim(substring(text, 1, 90)), '[^\w\s-]', '', 'g'), '\s+', '_', 'g'), 1, 50) AS name FROM documents WHERE text IS NOT NULL""")
def safe_names(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", sinks.safe_name(F.substring("text", 1, 90)).alias("name"))


@query(
    "truncated_texts",
    """SELECT doc_id, substring(text, 1, 100) AS head, CAST(least(strlen(text), 64) AS INTEGER) AS most_bytes, CAST(least(strlen(text), 64) - 3 AS INTEGER) AS least_bytes FROM documents WHERE text IS NOT NULL""",
)
def truncated_texts(spark, d):
    cut = documents.truncate(F.col("text"), max_bytes=64)
    size = F.least(F.octet_length("text"), F.lit(64))
    fits = F.col("text").startswith(cut) & F.octet_length(cut).between(size - 3, size)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", documents.truncate(F.col("text"), max_chars=100).alias("head"), F.when(fits, size).alias("most_bytes"), F.when(fits, size - 3).alias("least_bytes"))


@query(
    "fallback_contents",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'rendered' WHEN 2 THEN 'snippet' WHEN 3 THEN 'meta' ELSE '' END AS content, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.5 ELSE 0.4 END AS confidence FROM documents WHERE text <> ''""",
)
def fallback_contents(spark, d):
    k = F.col("doc_id") % 5
    given = lambda i, v: F.when(k == i, v)
    chosen = documents.fallback_content(given(0, F.col("text")), given(3, F.lit("meta")), given(2, F.lit("snippet")), given(1, F.lit("rendered")))
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.explode(F.array(chosen)).alias("c")).select("doc_id", "c.content", "c.confidence")


@query(
    "flattened_records",
    """SELECT o_orderkey AS "id", 'a' || o_orderkey AS "meta.name", CAST(o_custkey AS BIGINT) AS "meta.inner.n", 'x; y' || (o_orderkey % 3) AS "tags" FROM orders""",
)
def flattened_records(spark, d):
    inner = F.struct(F.concat(F.lit("a"), _s("o_orderkey")).alias("name"), F.struct(F.col("o_custkey").cast("long").alias("n")).alias("inner"))
    return ingest.flatten(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), inner.alias("meta"), F.array(F.lit("x"), F.concat(F.lit("y"), (F.col("o_orderkey") % 3).cast("string"))).alias("tags")))


@query("pruned_metadata", """SELECT o_orderkey, '{"a":"' || o_orderkey || '"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"b":"x"' ELSE '' END || '}' AS metadata FROM orders""")
def pruned_metadata(spark, d):
    body = F.concat(F.lit('{"a":"'), _s("o_orderkey"), F.lit('","b":'), F.when(F.col("o_orderkey") % 2 == 0, F.lit('"x"')).otherwise(F.lit('""')), F.lit(',"c":null,"d":[],"e":{}}'))
    return ingest.prune_empty(table(spark, d, "orders").select("o_orderkey", body.alias("metadata")))


@query("dns_errors", "SELECT o_orderkey, o_orderkey % 3 <> 1 AS dns FROM orders")
def dns_errors(spark, d):
    message = F.element_at(F.array(F.lit("[Errno -2] Name or service not known"), F.lit("Connection refused"), F.lit("Temporary failure in name resolution")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", quality.is_dns_error(message).alias("dns"))


@query("antibot_pages", "SELECT page_id, page_id % 3 = 1 OR length(html) < 200 OR regexp_matches(lower(html), 'cf-browser-verification|cf-challenge-form|data-ray-id|challenge-form|captcha|just a moment') AS antibot FROM pages")
def antibot_pages(spark, d):
    page = F.when(F.col("page_id") % 3 == 1, F.concat("html", F.lit("<div data-ray-id='1'></div>"))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", quality.looks_antibot(page).alias("antibot"))


@query("json_ld_blocks", """SELECT page_id, 1 + page_id % 3 AS blocks FROM pages""")
def json_ld_blocks(spark, d):
    block = F.lit("<script type='application/ld+json'>{\"@type\": \"Article\"}</script>")
    page = F.concat("html", F.array_join(F.array_repeat(block, (1 + F.col("page_id") % 3).cast("int")), " "))
    return table(spark, d, "pages").select("page_id", F.size(html.json_ld(page)).cast("long").alias("blocks"))
