"""Provider payloads to rows: social posts, repositories, wiki pages, videos, result pages.

Inputs are landed tables with a JSON or HTML column; JSON is read as VARIANT with
``try_`` functions, so a broken payload gives nulls and not a failed job.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse as parse_date
from ..functions.html import strip_tags, unescape_native
from ..functions.urls import host
from ..operators.documents import convert_count


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _each(rows: DataFrame, payload: str, path: str, *keep: str) -> DataFrame:
    """One row (n, v) for each element of the array at ``path`` of the JSON column."""
    parsed = rows.select(*keep, F.try_variant_get(F.try_parse_json(payload), path, "array<variant>").alias("vs"))
    return parsed.select(*keep, F.posexplode("vs").alias("n", "v"))


# ---------------------------------------------------------------------- social
ITEM = ("platform", "author", "content", "url", "timestamp")


def items(rows: DataFrame, platform: str | None = None) -> DataFrame:
    """Posts in the shape of social items, of one platform or by their column; all other columns go to ``metadata`` as JSON."""
    rest = [c for c in rows.columns if c not in ITEM]
    kind = F.col("platform") if platform is None else F.lit(platform)
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select(kind.alias("platform"), *[have(c).alias(c) for c in ITEM[1:]], (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("metadata"))


def envelopes(found: DataFrame, query: str) -> DataFrame:
    """(platform, query, result_count): what each platform gave; items stay rows, so a platform may give any number."""
    return found.groupBy("platform").agg(F.lit(query).alias("query"), F.count(F.lit(1)).alias("result_count"))


def reddit_posts(pages: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    rows = _each(pages, payload, "$.data.children", *keep)
    link = _get("v", "$.data.permalink")
    return rows.select(
        *keep, "n", _get("v", "$.data.title").alias("title"), _get("v", "$.data.author").alias("author"), _get("v", "$.data.subreddit").alias("subreddit"),
        F.coalesce(F.concat(F.lit("https://www.reddit.com"), link), _get("v", "$.data.url")).alias("url"), _get("v", "$.data.url").alias("external_url"),
        _get("v", "$.data.score", "long").alias("score"), _get("v", "$.data.num_comments", "long").alias("num_comments"),
        F.timestamp_seconds(_get("v", "$.data.created_utc", "double")).alias("published"), F.substring(F.coalesce(_get("v", "$.data.selftext"), F.lit("")), 1, 2000).alias("selftext"),
    )


def discord_messages(pages: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    """Messages; embeds speak for a message without text."""
    rows = _each(pages, payload, "$", *keep)
    embeds = F.coalesce(_get("v", "$.embeds", "array<struct<title:string,description:string>>"), F.array().cast("array<struct<title:string,description:string>>"))
    spoken = F.array_join(F.filter(F.flatten(F.transform(embeds, lambda e: F.array(e["title"], e["description"]))), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
    text = F.coalesce(_get("v", "$.content"), F.lit(""))
    reactions = _get("v", "$.reactions", "array<struct<emoji:struct<name:string>,count:bigint>>")
    return rows.select(
        *keep, "n", _get("v", "$.id").alias("id"), _get("v", "$.author.username").alias("author"), F.when(text != "", text).otherwise(spoken).alias("content"),
        parse_date(_get("v", "$.timestamp")).alias("timestamp"), F.transform(_get("v", "$.attachments", "array<struct<url:string>>"), lambda a: a["url"]).alias("attachments"),
        F.transform(reactions, lambda r: F.struct(r["emoji"]["name"].alias("emoji"), r["count"].alias("count"))).alias("reactions"),
        _get("v", "$.referenced_message.id").alias("reply_to"), _get("v", "$.channel_id").alias("channel_id"),
    )


def page_before(messages: DataFrame, before: str, k: int) -> DataFrame:
    """Keyset paging: the newest ``k`` messages with an id below ``before``."""
    number = F.col("id").cast("decimal(20,0)")
    return messages.where(number < F.lit(before).cast("decimal(20,0)")).orderBy(number.desc()).limit(k)


def instagram_posts(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """Posts of the JSON-LD blocks of profile pages."""
    from ..functions.html import json_ld

    block = pages.select(*keep, F.explode(json_ld(F.col(html))).alias("b")).select(*keep, F.try_parse_json("b").alias("p"))
    many = F.coalesce(F.try_variant_get("p", "$['@graph']", "array<variant>"), F.try_variant_get("p", "$", "array<variant>"), F.array("p"))
    rows = block.where("p is not null").select(*keep, F.explode(many).alias("v"))
    body = _get("v", "$.articleBody")
    return rows.where(_get("v", "$['@type']").isin("BlogPosting", "SocialMediaPosting", "Article") | (F.coalesce(body, F.lit("")) != "")).select(
        *keep, F.coalesce(_get("v", "$.author.name"), _get("v", "$.author")).alias("author"), F.coalesce(body, _get("v", "$.description"), _get("v", "$.headline"), F.lit("")).alias("content"),
        F.coalesce(_get("v", "$.mainEntityOfPage['@id']"), _get("v", "$.url")).alias("url"), _get("v", "$.datePublished").alias("timestamp"),
        F.coalesce(_get("v", "$.image.url"), _get("v", "$.image")).alias("image"), F.coalesce(_get("v", "$.headline"), F.lit("")).alias("title"),
    )


#: Classes of Telegram's public pages that tell a message's type, in order.
TELEGRAM_TYPES = (
    ("tgme_widget_message_poll", "poll"), ("tgme_widget_message_sticker_wrap", "sticker"), ("tgme_widget_message_roundvideo", "round-video"), ("tgme_widget_message_video_wrap", "video"),
    ("tgme_widget_message_photo_wrap", "photo"), ("tgme_widget_message_document", "document"), ("<audio", "audio"), ("tgme_widget_message_location_wrap", "location"),
)


def telegram_posts(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """Distinct posts of public channel pages, cut at their data-post marks."""
    parts = pages.select(*keep, F.posexplode(F.split(html, r'(?=<div[^>]*data-post=")')).alias("n", "p")).where(F.col("n") > 0)
    inside = lambda name: strip_tags(F.regexp_extract("p", rf'(?is)class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</(?:div|span|a)>', 1))
    text = inside("tgme_widget_message_text")
    kind = None
    for mark, name in TELEGRAM_TYPES:
        kind = F.when(F.col("p").contains(mark), name) if kind is None else kind.when(F.col("p").contains(mark), name)
    views = inside("tgme_widget_message_views")
    post = F.regexp_extract("p", r'data-post="([^"]+)"', 1)
    rows = parts.select(
        *keep, "n", post.alias("id"), F.concat(F.lit("https://t.me/"), post).alias("url"), kind.when(text == "", "service").otherwise("text").alias("type"), text.alias("text"),
        F.nullif(F.regexp_extract("p", r'<time[^>]*datetime="([^"]+)"', 1), F.lit("")).alias("date"), F.nullif(views, F.lit("")).alias("views"), convert_count(views).alias("views_count"),
        F.lower(inside("tgme_widget_message_meta")).contains("edited").alias("edited"), F.nullif(inside("tgme_widget_message_from_author"), F.lit("")).alias("author"),
    )
    from ..operators.dedup import first_wins

    return first_wins(rows, F.col("id"), *keep, "n")


# What a public page of a channel that does not exist says, and the classes that show that it does.
NOT_FOUND = ("if you have <strong>telegram</strong>", "channel not found", "no posts")
FOUND_CLASSES = ("tgme_widget_message_wrap", "tgme_channel_info_header_title")


def looks_not_found(html: Column) -> Column:
    """A page that was delivered, but of no channel: neither posts nor a title, and a mark that says so."""
    page = F.coalesce(html, F.lit(""))
    classes = "|".join(rf"class=[\"'][^\"']*\b{c}\b" for c in FOUND_CLASSES)
    return ~page.rlike(classes) & F.lower(page).rlike("|".join(NOT_FOUND))


# What each platform can be asked by, and the order in which the ways are tried; a query is the fallback.
CAPABILITIES = {"discord": ("channel_id", "query"), "instagram": ("query", "profile"), "reddit": ("query", "subreddit", "user"), "telegram": ("query", "channel")}
CAPABILITY_ORDER = ("channel", "channel_id", "subreddit", "profile", "user")


def chosen_capability(requests: DataFrame, platform: str = "platform", capabilities: dict[str, tuple[str, ...]] = CAPABILITIES) -> DataFrame:
    """``requests`` (platform and some of query, channel, channel_id, subreddit, profile, user), ``capability`` and ``error``.

    The first way that a platform supports and that has a value is taken, else its
    query; 'no_input' without either, 'unsupported_capability' where a platform has
    no query, 'unknown_platform' where there is no such platform.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != "" if c in requests.columns else F.lit(False)
    chosen, error = F, F
    for name, ways in sorted(capabilities.items()):
        own = F.coalesce(*[F.when(given(c), F.lit(c)) for c in CAPABILITY_ORDER if c in ways], F.when(given("query") & F.lit("query" in ways), F.lit("query")))
        chosen = chosen.when(F.col(platform) == name, own)
        error = error.when(F.col(platform) == name, F.lit("no_input" if "query" in ways else "unsupported_capability"))
    return requests.withColumn("capability", chosen).withColumn("error", F.when(F.col("capability").isNull(), error.otherwise("unknown_platform")))


def channel_name(text: Column) -> Column:
    """Channel of a link, an @name or a bare name."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?:https?://)?(?:www\.)?(?:t\.me|telegram\.me)/(?:s/)?", ""), r"^@|[/?].*$", ""))


# ---------------------------------------------------------------- repositories
def repositories(pages: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    v = pages.select(*keep, F.try_parse_json(payload).alias("v"))
    text = {"full_name": "full_name", "description": "description", "url": "html_url", "homepage": "homepage", "default_branch": "default_branch", "language": "language", "created_at": "created_at", "updated_at": "updated_at", "pushed_at": "pushed_at", "license": "license.spdx_id", "owner": "owner.login", "owner_type": "owner.type"}
    numbers = {"stars": "stargazers_count", "forks": "forks_count", "watchers": "subscribers_count", "open_issues_and_prs": "open_issues_count", "size_kb": "size"}
    flags = {"is_fork": "fork", "is_archived": "archived"}
    pick = lambda names, kind: [_get("v", f"$.{path}", kind).alias(name) for name, path in names.items()]
    return v.select(*keep, *pick(text, "string"), *pick(numbers, "long"), *pick(flags, "boolean"), F.coalesce(_get("v", "$.topics", "array<string>"), F.array().cast("array<string>")).alias("topics"))


def issues(pages: DataFrame, payload: str = "payload", *keep: str, pull_requests: bool = False) -> DataFrame:
    rows = _each(pages, payload, "$", *keep)
    is_pr = _get("v", "$.pull_request", "variant").isNotNull()
    rows = rows if pull_requests else rows.where(~is_pr)
    return rows.select(
        *keep, _get("v", "$.number", "long").alias("number"), _get("v", "$.title").alias("title"), _get("v", "$.state").alias("state"), _get("v", "$.user.login").alias("author"),
        F.transform(F.coalesce(_get("v", "$.labels", "array<struct<name:string>>"), F.array().cast("array<struct<name:string>>")), lambda x: x["name"]).alias("labels"),
        _get("v", "$.comments", "long").alias("comments"), _get("v", "$.created_at").alias("created_at"), _get("v", "$.closed_at").alias("closed_at"), _get("v", "$.html_url").alias("url"), is_pr.alias("is_pull_request"),
    )


def commits(pages: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    rows = _each(pages, payload, "$", *keep)
    return rows.select(
        *keep, _get("v", "$.sha").alias("sha"), F.split(_get("v", "$.commit.message"), "\n")[0].alias("title"), _get("v", "$.commit.message").alias("message"),
        _get("v", "$.commit.author.name").alias("author"), _get("v", "$.commit.author.date").alias("date"), _get("v", "$.html_url").alias("url"), _get("v", "$.commit.comment_count", "long").alias("comment_count"),
    )


def repo_ref(text: Column) -> Column:
    """Struct (owner, repo) of 'owner/repo' or a repository URL; null otherwise."""
    pattern = r"^(?:https?://)?(?:www\.)?(?:github\.com/)?([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?(?:[/?#].*)?$"
    t = F.trim(text)
    return F.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, 1).alias("owner"), F.regexp_extract(t, pattern, 2).alias("repo")))


def last_page(link_header: Column) -> Column:
    """Number of pages that a pagination header names."""
    return F.regexp_extract(F.coalesce(link_header, F.lit("")), r'[?&]page=(\d+)[^>]*>;\s*rel="last"', 1).try_cast("int")


# File types by extension.
FILE_TYPES = {
    "py": "code", "js": "code", "ts": "code", "java": "code", "go": "code", "rs": "code", "c": "code", "cpp": "code", "h": "code", "rb": "code", "php": "code", "scala": "code", "sh": "code", "sql": "code",
    "md": "markdown", "rst": "markdown", "txt": "text", "json": "config", "yaml": "config", "yml": "config", "toml": "config", "ini": "config", "cfg": "config", "xml": "config",
    "csv": "data", "tsv": "data", "parquet": "data", "html": "markup", "css": "markup", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "svg": "image", "ipynb": "notebook",
}


def file_type(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.when(name.isin("dockerfile", "makefile"), name).otherwise(F.coalesce(F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])[ext], F.lit("unknown")))


# ------------------------------------------------------------------------ wiki
# Namespaces that are no articles.
BLOCKED_PREFIXES = ("User:", "User talk:", "Talk:", "Wikipedia:", "Special:", "File:", "Template:", "Template talk:", "Category:", "Help:", "Portal:", "Draft:", "Module:", "MediaWiki:")


def wiki_pages(pages: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    """Page extracts with up to 100 article links and categories."""
    v = pages.select(*keep, F.explode(F.map_values(F.try_variant_get(F.try_parse_json(payload), "$.query.pages", "map<string,variant>"))).alias("v"))
    titles = lambda path: F.transform(F.slice(F.coalesce(_get("v", path, "array<struct<title:string>>"), F.array().cast("array<struct<title:string>>")), 1, 100), lambda x: x["title"])
    plain = lambda t: ~t.rlike("^(" + "|".join(BLOCKED_PREFIXES) + ")")
    return v.select(
        *keep, _get("v", "$.pageid", "long").alias("pageid"), _get("v", "$.title").alias("title"), _get("v", "$.fullurl").alias("url"), F.trim(F.regexp_replace(F.coalesce(_get("v", "$.extract"), F.lit("")), r"\s+", " ")).alias("extract"),
        F.array_distinct(F.filter(titles("$.links"), lambda t: t.isNotNull() & plain(t))).alias("links"), F.array_distinct(F.filter(titles("$.categories"), lambda t: t.isNotNull())).alias("categories"),
    )


def recent_changes(entries: DataFrame) -> DataFrame:
    """Wiki change feeds: article titles once each, diff tables reduced to their comment or text."""
    from ..operators.dedup import first_wins

    comment = F.regexp_extract("summary", r'(?is)<span class="autocomment">(.*?)</span>', 1)
    text = F.when(comment != "", strip_tags(comment)).otherwise(strip_tags(F.regexp_replace("summary", r"(?is)<table\b.*?</table>", " ")))
    articles = entries.where(~F.col("title").rlike("^(" + "|".join(BLOCKED_PREFIXES) + ")"))
    return first_wins(articles.withColumn("summary", text), F.col("title"), "feed_url", "n")


# ---------------------------------------------------------------------- videos
_VIDEO = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("video_id", "title", "channel", "duration", "views")]))


def _text(node) -> str | None:
    if isinstance(node, str) or node is None:
        return node
    if isinstance(node, dict):
        return node.get("simpleText") or node.get("label") or "".join(r.get("text", "") for r in node.get("runs", [])) or None
    return None


def _renderers(page: str | None) -> list[tuple]:
    """Every distinct video node anywhere in the page's embedded JSON (SQL JSON paths cannot recurse)."""
    found = re.search(r"ytInitialData\s*=\s*(\{.*?\});", page or "", re.S)
    try:
        open_nodes = [json.loads(found[1])] if found else []
    except ValueError:
        return []
    out: dict[str, tuple] = {}
    while open_nodes:
        node = open_nodes.pop()
        if isinstance(node, dict):
            video = node.get("videoRenderer")
            if isinstance(video, dict) and video.get("videoId"):
                out.setdefault(video["videoId"], (video["videoId"], _text(video.get("title")), _text(video.get("ownerText")), _text(video.get("lengthText")), _text(video.get("viewCountText"))))
            open_nodes += list(node.values())[::-1]
        elif isinstance(node, list):
            open_nodes += node[::-1]
    return list(out.values())


@F.pandas_udf(_VIDEO)
def _videos(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [dict(zip(("video_id", "title", "channel", "duration", "views"), v, strict=True)) for v in _renderers(p)])


def videos(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    rows = pages.select(*keep, F.posexplode(_videos(html)).alias("n", "v")).select(*keep, "n", "v.*")
    return rows.withColumn("url", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id"))


def transcript(segments: Column) -> Column:
    """Text of an array of (text, start, duration) segments."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), " ")


# ---------------------------------------------------------------- result pages
def result_page(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """(n, title, href, body) of an HTML search page: its links to other hosts with their following text."""
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(r"""(?is)(<a\s[^>]*href=["']https?://.*?)(?=<a\s|$)"""), F.lit(1))).alias("n", "p"))
    href = F.regexp_extract("p", r"""(?is)href=["'](https?://[^"']+)""", 1)
    wrapped = F.regexp_extract(href, r"[?&](?:uddg|url|u)=(https?[^&]+)", 1)
    return rows.select(
        *keep, "n", strip_tags(F.regexp_extract("p", r"(?is)^<a\b[^>]*>(.*?)</a>", 1)).alias("title"), F.when(wrapped != "", F.url_decode(wrapped)).otherwise(href).alias("href"),
        strip_tags(F.regexp_extract("p", r"(?is)^<a\b.*?</a>(.*)$", 1)).alias("body"),
    ).where("title <> ''")


# What titles of a publisher, or under a profile, end with.
TITLE_TAILS = {"times of india": (r"\s*-\s*Times of India\s*$", r"\s*-\s*TOI\s*$"), "google news": (r"\s*-\s*[^-]+$",)}


def plain_text(text: Column) -> Column:
    """Entities, tags and runs of white space resolved."""
    return F.trim(F.regexp_replace(F.regexp_replace(unescape_native(F.coalesce(text, F.lit(""))), "<[^>]+>", " "), r"\s+", " "))


def publisher_title(title: Column, publisher: Column, profile: str = "generic") -> Column:
    """News titles without the tails of their publisher and of the profile; under ``google_news`` without what follows the last ' - '."""
    t = plain_text(title)
    if profile == "google_news":
        t = F.trim(F.regexp_replace(t, r"^(.*) - .*$", "$1"))
    known = F.lower(F.coalesce(publisher, F.lit("")))
    for name, tails in TITLE_TAILS.items():
        cut = t
        for tail in tails:
            cut = F.trim(F.regexp_replace(cut, "(?i)" + tail, ""))
        t = cut if name == profile else F.when(known == name, cut).otherwise(t)
    return t


def description_parts(description: Column) -> Column:
    """Struct (link, text, source, source_url) of a feed's HTML description."""
    h = F.coalesce(description, F.lit(""))
    part = lambda pattern, group: F.regexp_extract(h, "(?is)" + pattern, group)
    anchor, tagged, font = r'<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', r'<source[^>]*url="([^"]+)"[^>]*>(.*?)</source>', r"<font[^>]*>(.*?)</font>"
    return F.struct(
        F.nullif(part(anchor, 1), F.lit("")).alias("link"), plain_text(F.when(h.rlike("(?is)" + anchor), part(anchor, 2)).otherwise(h)).alias("text"),
        plain_text(F.when(h.rlike("(?is)" + tagged), part(tagged, 2)).otherwise(part(font, 1))).alias("source"), F.nullif(part(tagged, 1), F.lit("")).alias("source_url"),
    )


def news_url(url: Column, description_link: Column) -> Column:
    """The article behind a news redirect: its q parameter, else the description's link if that leads elsewhere."""
    asked = F.url_decode(F.nullif(F.regexp_extract(url, "[?&]q=(https?://[^&]+)", 1), F.lit("")))
    return F.coalesce(asked, F.when((F.coalesce(description_link, F.lit("")) != "") & ~description_link.contains("news.google.com"), description_link), url)


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` and ``allowed``: no rule (host, disallow) of its host is a prefix of its path.  Unknown hosts are allowed."""
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    keyed = urls.withColumn("host", host(F.col(url))).withColumn("__path", path)
    barred = keyed.join(rules.select("host", "disallow"), "host").where((F.col("disallow") != "") & F.col("__path").startswith(F.col("disallow"))).select(url).distinct().withColumn("allowed", F.lit(False))
    return keyed.drop("__path").join(barred, url, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
