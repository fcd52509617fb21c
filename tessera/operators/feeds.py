"""Feed entries: parsing, normalisation, filters, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, query as Q, urls
from ..functions.html import unescape_native
from ..functions.text import collapse_space, occurrences, word_count

#: Entries taken from one feed.
FEED_CAP = 1000

_RSS = "struct<channel:struct<item:array<struct<title:string,link:string,guid:string,pubDate:string,description:string,author:string,creator:string>>>>"


def parse(feeds: DataFrame, xml: str = "xml", url: str = "feed_url", cap: int = FEED_CAP) -> DataFrame:
    """(feed_url, n, title, link, guid, published, summary, author) of RSS 2.0 and Atom documents, ``cap`` for each feed.

    Entries are cut out of the text and their fields read by patterns, so a
    malformed entry costs itself and not its feed.
    """
    entry = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))
    each = feeds.select(F.col(url).alias("feed_url"), F.posexplode(F.slice(entry, 1, cap)).alias("n", "e"))

    def inside(*names: str) -> Column:
        found = [F.nullif(F.regexp_extract("e", rf"(?is)<{x}\b[^>]*>(.*?)</{x}>", 1), F.lit("")) for x in names]
        raw = F.regexp_replace(F.coalesce(*found, F.lit("")), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        return F.trim(raw)

    link = F.coalesce(F.nullif(inside("link"), F.lit("")), F.nullif(F.regexp_extract("e", r"""(?is)<link\b[^>]*href=["']([^"']+)""", 1), F.lit("")), F.lit(""))
    return each.select(
        "feed_url", "n", unescape_native(inside("title")).alias("title"), unescape_native(link).alias("link"), inside("guid", "id").alias("guid"),
        inside("pubDate", "published", "updated", "dc:date").alias("published"), unescape_native(inside("description", "summary", "content")).alias("summary"),
        inside("dc:creator", "name", "author").alias("author"),
    )


def media(feeds: DataFrame, xml: str = "xml", url: str = "feed_url", need: str = "image") -> DataFrame:
    """Media-RSS and video Atom entries: (feed_url, n, title, link, media_url, width, height); image rows need a picture, video rows a link."""
    each = feeds.select(F.col(url).alias("feed_url"), F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))).alias("n", "e"))
    tag = F.regexp_extract("e", r"(?is)(<media:(?:content|thumbnail)\b[^>]*>)", 1)
    attr = lambda name: F.nullif(F.regexp_extract(tag, rf"""(?is)\b{name}=["']([^"']*)""", 1), F.lit(""))
    link = F.coalesce(F.nullif(F.trim(F.regexp_extract("e", r"(?is)<link\b[^>]*>([^<]+)</link>", 1)), F.lit("")), F.nullif(F.regexp_extract("e", r"""(?is)<link\b[^>]*href=["']([^"']+)""", 1), F.lit("")))
    rows = each.select(
        "feed_url", "n", unescape_native(F.trim(F.regexp_extract("e", r"(?is)<title\b[^>]*>(.*?)</title>", 1))).alias("title"), link.alias("link"),
        attr("url").alias("media_url"), attr("width").try_cast("int").alias("width"), attr("height").try_cast("int").alias("height"),
    )
    return rows.where(F.col("media_url").isNotNull() if need == "image" else F.col("link").isNotNull())


def normalize(raw: DataFrame) -> DataFrame:
    """Entries with clean title, URL, UTC date, plain summary of up to 5,000 characters, and counts.

    Reads (title, link, guid, published, summary, author); further columns pass through.
    """
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
    title = F.regexp_replace(collapse_space(F.coalesce("title", F.lit(""))), control, "")
    url = urls.normalize(F.trim(F.coalesce("link", F.lit(""))))
    plain = collapse_space(F.regexp_replace(F.coalesce("summary", F.lit("")), "<[^>]+>", " "))
    summary = F.when(F.length(plain) > 5000, F.concat(F.substring(plain, 1, 5000), F.lit("..."))).otherwise(plain)
    at = dates.parse(F.col("published"))
    words = word_count(summary)
    own = {"title", "link", "guid", "published", "summary", "author"}
    return raw.select(
        title.alias("title"), url.alias("url"), F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.trim(F.coalesce("published", F.lit("")))).alias("published"),
        summary.alias("summary"), F.trim(F.coalesce("author", F.lit(""))).alias("author"),
        F.coalesce(F.nullif(F.trim(F.coalesce("guid", F.lit(""))), F.lit("")), F.nullif(url, F.lit("")), title).alias("guid"),
        F.length(summary).alias("content_length"), words.alias("word_count"), F.greatest(F.lit(1), F.floor(words / 200)).cast("int").alias("reading_time_minutes"),
        *[c for c in raw.columns if c not in own],
    )


def category_of(url: Column) -> Column:
    """Category named in a /category/x or /tag/x path, else 'all'."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^[a-z]+://[^/]+/(?:category|tag)/([^/?#]+)", 1)), F.lit("")), F.lit("all"))


# Other names of categories, and the categories that have feeds.
CATEGORY_ALIASES = {
    "artificial-intelligence": "ai", "ml": "ai", "machine-learning": "ai", "media-entertainment": "media", "social-media": "social", "vc": "venture", "venture-capital": "venture",
    "crypto": "cryptocurrency", "cryptocurrencies": "cryptocurrency", "ecommerce": "commerce", "e-commerce": "commerce",
}
CATEGORIES = (
    "all", "news", "business", "startups", "venture", "ai", "space", "apps", "security", "enterprise", "fintech", "transportation", "robotics", "hardware", "mobile", "gaming", "cloud",
    "cryptocurrency", "climate", "social", "commerce", "open_source", "sports", "football", "cricket", "tennis", "movies", "television", "music", "fashion", "beauty", "food", "travel", "cars",
    "architecture", "books", "interior_design", "diy", "funny", "history", "personal_finance", "photography", "science",
)


def category(name: Column) -> Column:
    """A category by its own or another name."""
    n = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("-"))
    return F.coalesce(F.create_map(*[x for k, v in CATEGORY_ALIASES.items() for x in (F.lit(k), F.lit(v))])[n], n)


def is_category(name: Column) -> Column:
    return F.coalesce(category(name).isin(*CATEGORIES), F.lit(False))


def enrich(entries: DataFrame, now: Column, feed_url: str = "feed_url", asked: str | None = None) -> DataFrame:
    """``entries`` with feed_name, category and fetched_at; the category is the one ``asked`` for, if there is such a one, else the feed URL's."""
    own = F.lower(F.regexp_extract(feed_url, r"^[a-z]+://[^/]+/+(?:category|tag)/+([^/?#]+)", 1))
    found = F.when(own != "", category(own)).otherwise("all")
    chosen = F.when(is_category(F.col(asked)), category(F.col(asked))).otherwise(found) if asked else found
    name = F.replace(F.regexp_extract(feed_url, r"^[a-z]+://([^/?#]+)", 1), F.lit("www."), F.lit(""))
    return entries.withColumns({"feed_name": F.when(name != "", name).otherwise("techcrunch"), "category": chosen, "fetched_at": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")})


# The feeds of each location.
LOCATION_FEEDS = {
    "india": ("https://timesofindia.indiatimes.com/rssfeeds/-2128936835.cms",), "world": ("https://timesofindia.indiatimes.com/rssfeeds/296589292.cms",),
    "us": ("https://timesofindia.indiatimes.com/rssfeeds_us/72258322.cms", "https://timesofindia.indiatimes.com/rssfeeds/30359486.cms"), "pakistan": ("https://timesofindia.indiatimes.com/rssfeeds/30359534.cms",),
    "uk": ("https://timesofindia.indiatimes.com/rssfeeds/2177298.cms",), "europe": ("https://timesofindia.indiatimes.com/rssfeeds/1898274.cms",), "china": ("https://timesofindia.indiatimes.com/rssfeeds/1898184.cms",),
    "india-delhi": ("https://timesofindia.indiatimes.com/rssfeeds/-2128839596.cms",), "india-bangalore": ("https://timesofindia.indiatimes.com/rssfeeds/-2128833038.cms",),
    "india-hyderabad": ("https://timesofindia.indiatimes.com/rssfeeds/-2128816011.cms",),
}


def location_feeds(location: Column) -> Column:
    """Feed URLs of a location, whatever its case; none of an unknown one."""
    key = F.replace(F.lower(F.trim(location)), F.lit(" "), F.lit("-"))
    urls = F.create_map(*[x for k, v in LOCATION_FEEDS.items() for x in (F.lit(k), F.array(*[F.lit(u) for u in v]))])
    return F.coalesce(urls[key], F.array().cast("array<string>"))


def location_news(requests: DataFrame, landed: DataFrame, cap: int = 5) -> DataFrame:
    """(source, n, title, url, body, author, date) of the feeds of the requested ``location``s: per feed the first ``cap`` entries with title and link, each URL once.

    ``requests`` has (pos, location), ``landed`` (feed_url, xml).
    """
    from .dedup import first_wins

    label = F.replace(F.lower(F.trim("location")), F.lit(" "), F.lit("-"))
    wanted = requests.select("pos", label.alias("label"), F.posexplode(location_feeds(F.col("location"))).alias("k", "feed_url"))
    entries = parse(landed).where((F.col("title") != "") & (F.col("link") != ""))
    plain = F.trim(F.regexp_replace(F.regexp_replace("summary", "<[^>]+>", " "), r"\s+", " "))
    rows = wanted.join(entries, "feed_url").select("pos", "k", F.concat(F.lit("toi-"), "label").alias("source"), "feed_url", "n", "title", F.col("link").alias("url"), plain.alias("body"), "author", F.col("published").alias("date"))
    once = first_wins(rows, F.col("url"), "pos", "k", "n")
    first = once.withColumn("__n", F.row_number().over(Window.partitionBy("pos", "k").orderBy("n"))).where(F.col("__n") <= cap)
    return first.select("source", "n", "title", "url", "body", "author", "date")


# The feed tags that words and phrases of a query stand for.
TAGS = {
    "gallery": "gallery", "art": "digitalart traditional painting", "digital art": "digitalart", "digital": "digitalart", "digitalart": "digitalart", "painting": "painting traditional",
    "drawing": "drawing traditional", "drawings": "drawing traditional", "illustration": "illustration", "concept art": "conceptart characterdesign", "concept": "conceptart",
    "character design": "characterdesign", "original character": "originalcharacter characterdesign", "oc": "originalcharacter", "portrait": "portraits", "portraits": "portraits",
    "abstract": "abstract abstractart", "neon": "neon", "graphic design": "graphicdesign", "procreate": "procreate", "ipad art": "ipadart", "ipad": "ipadart", "firealpaca": "firealpaca",
    "3d art": "3d", "3d": "3d", "science fiction": "scifi", "scifi": "scifi", "sci-fi": "scifi", "superheroes": "superheroes", "superhero": "superheroes", "comics": "comics", "comic": "comics",
    "game art": "gameart", "video game": "videogamefanart gameart", "videogame": "videogamefanart gameart", "fantasy": "fantasy magicrealms", "fantasy art": "fantasy",
    "magic": "magicrealms magicalgirls", "magic realms": "magicrealms", "magical girl": "magicalgirls", "magical girls": "magicalgirls", "anime": "anime animemanga",
    "anime and manga": "animemanga", "manga": "manga animemanga", "animegirls": "animegirls anime", "anime girls": "animegirls anime", "cute": "cute kawaii", "kawaii": "kawaii",
    "cute and kawaii": "cute kawaii", "disney": "disney", "netflix": "netflix", "witches": "witches", "witch": "witches", "creatures": "creatures", "creature": "creatures",
    "space": "space skyscapes", "skyscapes": "skyscapes", "skyscape": "skyscapes", "fategrandorder": "fategrandorder", "fate grand order": "fategrandorder", "fgo": "fategrandorder",
    "dnd": "dnd rpg", "dungeons and dragons": "dnd rpg", "dungeons": "dnd rpg", "dragons": "dnd fantasy", "dragon": "dnd fantasy", "elves": "elves", "elf": "elves", "elves (elf)": "elves",
    "swords": "swords", "sword": "swords", "fighters": "fighters", "fighter": "fighters", "assassins": "assassins", "assassin": "assassins", "rpg": "rpg dnd",
    "character concept": "characterconcept conceptart", "fantasy characters": "fantasycharacters fantasy", "reference sheet": "referencesheet", "warrior cats": "warriorcats",
    "warrior": "warriorcats fighters", "scp": "scpfoundation", "scp foundation": "scpfoundation", "adoptables": "adoptables", "adoptable": "adoptables",
    "adoptable auctions": "adoptableauctions", "open adoptables": "adoptables", "closed species": "closedspecies", "fursona": "fursona", "photography": "photography", "photo": "photography",
    "nature photography": "naturephotography photography", "nature": "naturephotography photography", "cosplay": "cosplay", "fan art": "fanart", "fanart": "fanart", "fan": "fanart",
}
TAG_FEED = "https://backend.deviantart.com/rss.xml?q=%s&type=deviation"


def tag_feeds(query: Column) -> Column:
    """URLs of the tag feeds for a query: those of its known words, longer phrases first, else one of the whole query; none for an empty one."""
    low = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    known = [F.when(padded.contains(f" {word} "), F.array(*[F.lit(t) for t in TAGS[word].split()])).otherwise(F.array().cast("array<string>")) for word in sorted(TAGS, key=len, reverse=True)]
    tags = F.array_distinct(F.concat(*known))
    own = F.array(F.replace(low, F.lit(" "), F.lit("")))
    chosen = F.when(low == "", F.array().cast("array<string>")).when(F.size(tags) > 0, tags).otherwise(own)
    return F.transform(chosen, lambda t: F.format_string(TAG_FEED, F.url_encode(t)))


# ------------------------------------------------------------------- filters
def by_date(rows: DataFrame, ts: Column, now: Column | None = None, days: float | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Within the last ``days`` and from ``start`` to ``end`` inclusive; undated rows go."""
    keep = ts.isNotNull()
    if days is not None:
        keep &= dates.age_hours(ts, now) / 24 <= days
    if start:
        keep &= ts >= F.to_timestamp(F.lit(start))
    if end:
        keep &= ts <= F.to_timestamp(F.lit(end))
    return rows.where(keep)


def by_author(rows: DataFrame, author: str) -> DataFrame:
    return rows.where(F.lower(F.coalesce("author", F.lit(""))).contains(author.lower().strip()))


def by_keyword(rows: DataFrame, keyword: str, *columns: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    return rows.where(text.contains(keyword.lower().strip()))


def by_dimensions(rows: DataFrame, min_width: int | None = None, max_width: int | None = None, min_height: int | None = None, max_height: int | None = None) -> DataFrame:
    """Unknown dimensions fail only where a bound is set."""
    for column, bound, low in (("width", min_width, True), ("width", max_width, False), ("height", min_height, True), ("height", max_height, False)):
        if bound is not None:
            rows = rows.where(F.col(column) >= bound if low else F.col(column) <= bound)
    return rows


# ------------------------------------------------------------------- ranking
# Field weights and bonuses of entry ranking.
FIELD_WEIGHTS = {"title": 10.0, "summary": 5.0, "author": 2.0, "url": 1.0, "domain": 2.0, "content": 8.0}
PHRASE_IN_TITLE, PHRASE_IN_SUMMARY, PHRASE_IN_CONTENT, PHRASE_ELSEWHERE = 40.0, 20.0, 30.0, 10.0
ALL_TERMS, RECENCY, RECENCY_DECAY, FUZZY = 15.0, 60.0, 1.2, 3.0


def rank(rows: DataFrame, query: str, ts: Column, now: Column) -> DataFrame:
    """Entries with all required and no excluded terms, and ``score``, ``match_count`` and ``confidence``; unsorted.

    Columns of ``FIELD_WEIGHTS`` that are missing count as empty.
    """
    terms = Q.parse(query, bare_required=True)
    if not terms.required and not terms.phrases:
        return rows.where(F.lit(False)).withColumns({"score": F.lit(0.0), "match_count": F.lit(0), "confidence": F.lit(0.0)})
    flat = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))) if c in rows.columns else F.lit("")
    prepared = rows.select("*", F.explode(F.array(F.struct(*[flat(c).alias(c) for c in FIELD_WEIGHTS]))).alias("__f"))
    text = {c: F.col("__f")[c] for c in FIELD_WEIGHTS}
    combined = F.concat_ws(" ", *[text[c] for c in ("title", "summary", "author", "url", "domain", "content")])
    tight = F.replace(combined, F.lit(" "), F.lit(""))
    near = lambda w: combined.contains(w) | tight.contains(w.replace(" ", ""))
    keep = F.lit(True)
    for w in terms.excluded:
        keep &= ~combined.contains(w)
    for w in terms.required:
        keep &= near(w)
    score, matches, every = F.lit(0.0), F.lit(0), F.lit(True)
    for p in dict.fromkeys(terms.phrases):
        where = F.when(text["title"].contains(p), PHRASE_IN_TITLE).otherwise(0.0) + F.when(text["summary"].contains(p), PHRASE_IN_SUMMARY).otherwise(0.0) + F.when(text["content"].contains(p), PHRASE_IN_CONTENT).otherwise(0.0)
        found = F.when(where > 0, where).when(combined.contains(p), PHRASE_ELSEWHERE).otherwise(0.0)
        score, matches = score + found, matches + (found > 0).cast("int")
    for w in dict.fromkeys(terms.required):
        counted = sum((occurrences(text[c], w) * v for c, v in FIELD_WEIGHTS.items()), F.lit(0.0))
        found = F.when(counted > 0, counted).when(near(w), FUZZY).otherwise(0.0)
        score, matches, every = score + found, matches + (found > 0).cast("int"), every & combined.contains(w)
    if terms.required:
        score = score + F.when(every, ALL_TERMS).otherwise(0.0)
    age = F.greatest(dates.age_hours(ts, now) / 24, F.lit(0.0))
    score = score + F.coalesce(F.greatest(F.lit(0.0), RECENCY - RECENCY_DECAY * age), F.lit(0.0))
    ranked = prepared.where(keep).withColumn("score", score).withColumn("match_count", matches).drop("__f").where(F.col("score") > 0)
    return ranked.withColumn("confidence", F.least(F.lit(1.0), F.col("score") / 200))


def sort_newest(rows: DataFrame, ts: Column) -> DataFrame:
    """Undated last, newest first, then by title."""
    return rows.orderBy(ts.isNull(), ts.desc(), F.lower("title"))


def capped(rows: DataFrame, partition: str, cap: int, *order: str) -> DataFrame:
    """The first ``cap`` rows of each feed or location."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")
