"""Facets and feed analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, urls

# Words that are no keywords of feeds.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "have", "has", "will", "what", "when", "where", "who", "why", "how", "said", "says",
    "about", "after", "before", "into", "through", "during", "more", "most", "also", "than", "been", "were", "they", "their", "there", "these",
    "those", "which", "your", "our", "can", "could", "would", "should", "may", "might",
)
# Names that stand for no author.
NO_AUTHOR = ("unknown", "anonymous", "n/a")


def facet_values(url: Column, date: Column, source: Column, lang: Column) -> dict[str, Column]:
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return {
        "domain": known(urls.host(url)),
        "date": F.coalesce(dates.month(date), F.lit("unknown")),
        "source": F.lower(known(source)),
        "language": F.when(F.coalesce(lang, F.lit("")) == "", F.lit("unknown")).otherwise(F.substring(F.lower(lang), 1, 2)),
    }


def facets(rows: DataFrame, url: str = "url", date: str = "publish_date", source: str = "source", lang: str = "lang", most: int = 50) -> DataFrame:
    """(facet, value, count): the ``most`` frequent values of each facet; ties by value.

    Only the four values of a row reach the exchange, and they are counted before it.
    """
    values = facet_values(F.col(url), F.col(date), F.col(source), F.col(lang))
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in values.items()])).alias("f")).select("f.*")
    counts = pairs.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= most).drop("place")


def drill_down(rows: DataFrame, facet: str, value: str, url: str = "url", date: str = "publish_date", source: str = "source", lang: str = "lang") -> DataFrame:
    return rows.where(facet_values(F.col(url), F.col(date), F.col(source), F.col(lang))[facet] == value)


def top_authors(rows: DataFrame, author: str = "author", pos: str = "pos", k: int = 10, samples: int = 5) -> DataFrame:
    """(author, count, articles): authors by number of articles, with the first few positions."""
    name = F.trim(F.coalesce(F.col(author), F.lit("")))
    real = rows.where((name != "") & ~F.lower(name).isin(*NO_AUTHOR)).select(name.alias("author"), F.col(pos).alias("pos"))
    top = real.groupBy("author").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "author").limit(k)
    # k authors at most: their articles are numbered, not gathered
    first = real.join(F.broadcast(top.select("author")), "author").withColumn("n", F.row_number().over(Window.partitionBy("author").orderBy("pos"))).where(F.col("n") <= samples)
    return top.join(first.groupBy("author").agg(F.array_sort(F.collect_list("pos")).alias("articles")), "author")


def top_keywords(rows: DataFrame, *columns: str, k: int = 20, least: int = 4) -> DataFrame:
    """(keyword, count) of a-z words that are no stop words; ties by word."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    words = rows.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?U)\b([a-z]+)\b"), F.lit(1))).alias("keyword"))
    counted = words.where((F.length("keyword") >= least) & ~F.col("keyword").isin(*STOP_WORDS)).groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "keyword").limit(k)


def activity(rows: DataFrame, feed: str = "feed_url", domain: str = "domain", ts: Column | None = None, days: int = 30) -> DataFrame:
    """(dimension, value, count) by feed, by domain and by day (the latest ``days``), in one pass."""
    day = F.date_format(ts if ts is not None else dates.parse(F.col("published")), "yyyy-MM-dd")
    pair = lambda name, c: F.struct(F.lit(name).alias("dimension"), c.alias("value"))
    pairs = rows.select(F.explode(F.array(pair("feed", F.col(feed)), pair("domain", F.col(domain)), pair("day", day))).alias("p")).select("p.*").where(F.coalesce("value", F.lit("")) != "")
    counts = pairs.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count"))
    late = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("value")))
    recent = counts.where(F.col("dimension") == "day").withColumn("n", late).where(F.col("n") <= days).drop("n")
    return counts.where(F.col("dimension") != "day").unionByName(recent)


def distribution(rows: DataFrame, *dimensions: str) -> DataFrame:
    """One row: rows and distinct non-empty values of each dimension."""
    return rows.agg(F.count(F.lit(1)).alias("total_entries"), *[F.count_distinct(F.nullif(F.col(d), F.lit(""))).alias(f"unique_{d}") for d in dimensions])


def feed_status(rows: DataFrame, status: str = "status", redirected: str = "redirected") -> DataFrame:
    """One row: valid, invalid, redirected and unreachable counts."""
    s = F.col(status)
    return rows.agg(
        F.count_if(s.between(200, 299)).alias("valid"),
        F.count_if(s.between(400, 599)).alias("invalid"),
        F.count_if(F.coalesce(F.col(redirected), F.lit(False))).alias("redirected"),
        F.count_if(s.isNull()).alias("unreachable"),
    )


def runtime_statistics(events: DataFrame, kind: str, millis: str, hit: str) -> DataFrame:
    """(kind, count, avg_ms, cache_hit_rate), zeros where there is nothing to divide."""
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return events.groupBy(kind).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(safe(F.sum(millis), F.count(millis)), 2).alias("avg_ms"),
        F.round(safe(F.count_if(F.col(hit)).cast("double"), F.count(hit)), 3).alias("cache_hit_rate"),
    )
