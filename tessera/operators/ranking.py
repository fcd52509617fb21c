"""Staged ranking, composite scores, rank fusion, social ranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, query as Q, urls
from ..functions.text import let, occurrences, word_count
from ..shared import stored
from . import bm25f

# Quality of candidate sources, in order of precedence for prefixes.
SOURCE_QUALITY: tuple[tuple[str, float], ...] = (
    ("techcrunch", 1.0), ("techcrunch:ai", 1.0), ("techcrunch:startups", 1.0), ("techcrunch:security", 1.0), ("techcrunch:cloud", 1.0),
    ("google-news", 0.95), ("duckduckgo", 0.90), ("timesofindia", 0.85), ("toi", 0.85),
    ("wikimedia:wikipedia", 1.0), ("wikimedia:commons", 0.9), ("wikimedia:wiktionary", 0.85), ("wikimedia:wikivoyage", 0.85),
    ("wikimedia:wikibooks", 0.85), ("wikimedia:wikidata", 0.95), ("wikimedia:wikiversity", 0.85), ("wikimedia:wikiquote", 0.8),
    ("wikimedia:mediawiki", 0.85), ("wikimedia:wikisource", 0.85), ("wikimedia:wikispecies", 0.8), ("wikimedia:wikifunctions", 0.8),
    ("rss:en.wikipedia.org", 0.95), ("rss:commons.wikimedia.org", 0.85), ("rss:www.wikidata.org", 0.9), ("rss:en.wiktionary.org", 0.8),
    ("rss:en.wikivoyage.org", 0.8), ("rss:en.wikibooks.org", 0.8), ("rss:en.wikiversity.org", 0.8), ("rss:en.wikiquote.org", 0.75),
    ("rss:www.mediawiki.org", 0.8), ("rss:en.wikisource.org", 0.8), ("rss:species.wikimedia.org", 0.75), ("rss:www.wikifunctions.org", 0.75),
    ("rss:simple.wikipedia.org", 0.85), ("rss:www.nasa.gov", 0.95), ("rss:www.flickr.com", 0.85), ("rss:www.youtube.com", 0.9),
)
DEFAULT_QUALITY = 0.80

# Authority of known domains; others have 0.5.
AUTHORITY: dict[str, float] = {
    "arxiv.org": 0.95, "doi.org": 0.95, "nature.com": 0.95, "science.org": 0.95, "sciencedirect.com": 0.90,
    "springer.com": 0.90, "wiley.com": 0.88, "pubmed.ncbi.nlm.nih.gov": 0.95, "ncbi.nlm.nih.gov": 0.93, "scholar.google.com": 0.92,
    "semanticscholar.org": 0.90, "openalex.org": 0.88, "crossref.org": 0.88, "europepmc.org": 0.90, "jstor.org": 0.88,
    "ieee.org": 0.88, "acm.org": 0.88, "plos.org": 0.87, "biorxiv.org": 0.87, "doaj.org": 0.85,
    "github.com": 0.92, "gitlab.com": 0.85, "stackoverflow.com": 0.90, "stackexchange.com": 0.85, "npmjs.com": 0.82,
    "pypi.org": 0.85, "docs.python.org": 0.95, "developer.mozilla.org": 0.93, "kernel.org": 0.92, "crates.io": 0.80,
    "wikipedia.org": 0.85, "en.wikipedia.org": 0.85, "wikidata.org": 0.85, "wikimedia.org": 0.82, "britannica.com": 0.88,
    "reuters.com": 0.92, "ap.org": 0.91, "bbc.com": 0.90, "bbc.co.uk": 0.90, "nytimes.com": 0.88,
    "theguardian.com": 0.87, "washingtonpost.com": 0.87, "economist.com": 0.88, "bloomberg.com": 0.87, "ft.com": 0.87,
    "wsj.com": 0.86, "npr.org": 0.87, "aljazeera.com": 0.82, "techcrunch.com": 0.80, "theverge.com": 0.78,
    "arstechnica.com": 0.80, "wired.com": 0.78, "gov.uk": 0.92, "usa.gov": 0.92, "nasa.gov": 0.95,
    "europa.eu": 0.92, "cdc.gov": 0.95, "nih.gov": 0.95, "fda.gov": 0.93, "open.fda.gov": 0.93,
    "usgs.gov": 0.93, "noaa.gov": 0.92, "huggingface.co": 0.85, "zenodo.org": 0.87, "data.gov": 0.88,
    "kaggle.com": 0.80, "archive.org": 0.85, "internetarchive.org": 0.85, "gutenberg.org": 0.88, "openlibrary.org": 0.82,
    "worldcat.org": 0.85, "metmuseum.org": 0.90, "artic.edu": 0.88, "myanimelist.net": 0.75, "musicbrainz.org": 0.85,
    "openstreetmap.org": 0.85, "gdeltproject.org": 0.82, "news.ycombinator.com": 0.78,
}
DEFAULT_AUTHORITY = 0.5

# Fixed values: (relevance, authority, freshness, diversity) weights by content type.
WEIGHTS: dict[str, tuple[float, float, float, float]] = {
    "academic": (0.35, 0.40, 0.05, 0.20), "news": (0.30, 0.20, 0.35, 0.15), "event": (0.25, 0.15, 0.40, 0.20),
    "dataset": (0.35, 0.35, 0.10, 0.20), "book": (0.40, 0.35, 0.05, 0.20), "media": (0.35, 0.20, 0.10, 0.35),
    "geo": (0.40, 0.35, 0.10, 0.15), "knowledge": (0.35, 0.40, 0.05, 0.20), "podcast": (0.35, 0.20, 0.25, 0.20),
    "code": (0.30, 0.40, 0.10, 0.20), "web": (0.40, 0.25, 0.15, 0.20),
}
GENERAL_WEIGHTS = (0.40, 0.25, 0.15, 0.20)


def source_quality(source: Column, table: tuple[tuple[str, float], ...] = SOURCE_QUALITY) -> Column:
    """Exact name, else the first name that is a prefix, else the default.  The table is a constant of the library."""
    s = F.lower(F.coalesce(source, F.lit("")))
    out = F.create_map(*[x for k, v in table for x in (F.lit(k), F.lit(v))])[s]
    prefix = None
    for name, value in table:
        prefix = F.when(s.startswith(name), value) if prefix is None else prefix.when(s.startswith(name), value)
    return F.coalesce(out, prefix, F.lit(DEFAULT_QUALITY))


def authority_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AUTHORITY.items()), "domain string, seed double")


def with_authority(rows: DataFrame, url: str = "url", adjustments: DataFrame | None = None) -> DataFrame:
    """``rows`` and ``authority``: the domain's seed plus its learned adjustment, within 0 and 1.

    ``adjustments`` has (domain, alpha, beta); it may be large and is joined by key.
    """
    # the seed table is a constant of under a hundred rows
    out = rows.withColumn("domain", urls.host(F.col(url))).join(F.broadcast(authority_table(rows.sparkSession)), "domain", "left")
    seed = F.coalesce("seed", F.lit(DEFAULT_AUTHORITY))
    if adjustments is None:
        return out.withColumn("authority", seed).drop("seed")
    n = F.col("alpha") + F.col("beta") - 2
    shift = F.when(n > 0, (F.col("alpha") / (F.col("alpha") + F.col("beta")) - 0.5) * F.least(n / 20, F.lit(1.0))).otherwise(0.0)
    joined = out.join(adjustments.select("domain", "alpha", "beta"), "domain", "left")
    return joined.withColumn("authority", F.greatest(F.lit(0.0), F.least(F.lit(1.0), seed + F.coalesce(shift, F.lit(0.0))))).drop("seed", "alpha", "beta")


def relevance(text: Column, terms: Q.Terms) -> Column:
    """Struct (score, matches): 10 for each occurrence of a required term, 20 of a phrase; nothing with an excluded term."""

    def counted(t: Column) -> Column:
        words = reduce(lambda a, x: a + occurrences(t, x), terms.required, F.lit(0))
        runs = reduce(lambda a, x: a + occurrences(t, x), terms.phrases, F.lit(0))
        barred = reduce(lambda a, x: a | t.contains(x), terms.excluded, F.lit(False))
        return F.when(barred, F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("matches"))).otherwise(let(F.struct(words.alias("w"), runs.alias("r")), lambda n: F.struct((10.0 * n["w"] + 20.0 * n["r"]).alias("score"), (n["w"] + n["r"]).alias("matches"))))

    return let(F.lower(F.coalesce(text, F.lit(""))), counted)


def matched_terms(texts: list[Column], terms: list[str]) -> Column:
    """The terms that are part of any of ``texts``, sorted."""
    low = [F.lower(F.coalesce(t, F.lit(""))) for t in texts]
    hit = lambda x: low[0].contains(x) if len(low) == 1 else low[0].contains(x) | low[1].contains(x)
    return F.array_sort(F.array_compact(F.array(*[F.when(hit(x), F.lit(x)) for x in dict.fromkeys(terms)])))


def rank_initial(candidates: DataFrame, query: str, now: Column, k: int | None = 15) -> DataFrame:
    """Metadata ranking: BM25F of title, snippet and url, times source quality and recency."""
    weights = {f: w for f, w in bm25f.Settings().weights.items() if f != "content"}
    found = bm25f.scores(candidates, query, settings=bm25f.Settings(weights=weights))
    boost_s = 0.8 + 0.2 * source_quality(F.col("source"))
    boost_r = 1.0 + 0.2 * dates.recency_step(dates.parse(F.col("publish_date")), now)
    base = F.coalesce("bm25f", F.lit(0.0))
    ranked = candidates.join(found, "pos", "left").withColumns(
        {
            "initial_rank_score": base * boost_s * boost_r,
            "rank_breakdown": F.create_map(F.lit("bm25f"), F.round(base, 4), F.lit("source"), F.round(boost_s, 4), F.lit("recency"), F.round(boost_r, 4)),
            "matched_terms": matched_terms([F.col("title"), F.col("snippet")], Q.stems(query)),
        }
    )
    ranked = ranked.withColumn("match_count", F.size("matched_terms")).withColumn("rank_method", F.lit("bm25f")).drop("bm25f")
    return ranked if k is None else bm25f.top(ranked, "initial_rank_score", k)


def rank_legacy(candidates: DataFrame, query: str, now: Column, k: int | None = 15, provider_score: str | None = None) -> DataFrame:
    """Term-count ranking: 3 title + 2 body + 10 quality + 15 recency + a tenth of the provider's score (at most 10)."""
    terms = Q.parse(query)
    t, b = relevance(F.col("title"), terms), relevance(F.col("snippet"), terms)
    provider = F.least(F.coalesce(F.col(provider_score), F.lit(0)) / 10, F.lit(10.0)) if provider_score else F.lit(0.0)
    total = 3.0 * t["score"] + 2.0 * b["score"] + 10.0 * source_quality(F.col("source")) + 15.0 * dates.recency_step(dates.parse(F.col("publish_date")), now) + provider
    ranked = candidates.withColumn("initial_rank_score", total).withColumn("match_count", t["matches"] + b["matches"]).withColumn("rank_method", F.lit("legacy"))
    return ranked if k is None else bm25f.top(ranked, "initial_rank_score", k)


def rank_final(rows: DataFrame, query: str, k: int | None = 10, content: str = "content") -> DataFrame:
    """Content ranking: initial score + 3 content + quality (5 any, 3 over 500 characters, 2 not blocked) + half the density (at most 10)."""
    from .quality import is_barred

    text = F.coalesce(F.col(content), F.lit(""))
    # explode of one element keeps the optimizer from measuring a text at each use
    measured = F.struct(relevance(text, Q.parse(query)).alias("c"), is_barred(text).alias("barred"), word_count(text).alias("words"))
    each = rows.select("*", F.explode(F.array(measured)).alias("__m"))
    c = F.col("__m.c")
    quality = F.when(text != "", 5.0).otherwise(0.0) + F.when(F.length(text) > 500, 3.0).otherwise(0.0) + F.when((text != "") & F.col("__m.barred"), 0.0).otherwise(2.0)
    density = F.coalesce(F.try_divide(100.0 * c["matches"], F.col("__m.words")), F.lit(0.0))
    total = F.coalesce("initial_rank_score", F.lit(0.0)) + 3.0 * c["score"] + quality + 0.5 * F.least(density, F.lit(10.0))
    ranked = each.withColumn("final_rank_score", total).withColumn("keyword_density", density).drop("__m")
    return ranked if k is None else bm25f.top(ranked, "final_rank_score", k)


def staged(candidates: DataFrame, query: str, now: Column, extract: Callable[[DataFrame], DataFrame], first: int = 15, last: int = 10) -> DataFrame:
    """Initial top ``first`` on metadata, then ``extract`` on those alone, then the final top ``last``."""
    return rank_final(extract(rank_initial(candidates, query, now, first)), query, last)


def fuse(*ranked: DataFrame, key: str = "pos", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (key, rank) lists, ranks from 1."""
    lists = ranked[0].select(key, "rank")
    for other in ranked[1:]:
        lists = lists.unionByName(other.select(key, "rank"))
    return lists.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def with_rank(rows: DataFrame, score: str, key: str = "pos", limit: int | None = None) -> DataFrame:
    """``rows`` and ``rank`` from 1 by descending score, ties by key.

    With ``limit`` only the best rows stay, few enough for one window.  Without it
    all rows are ranked where they are sorted: by their place in their range
    partition and the sizes of the partitions before it.
    """
    if limit is not None:
        return rows.orderBy(F.desc(score), F.asc(key)).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))
    from .graph import cut

    # written, since the ids hold for one division into partitions only; partition number in the upper bits
    placed = cut(rows.orderBy(F.desc(score), F.asc(key)).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))  # one row for each partition
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return ranked.withColumn("rank", (F.col("__before") + inside + 1).cast("int")).drop("__at", "__part", "__before")


def min_max(rows: DataFrame, score: str, out: str, *partition: str) -> DataFrame:
    """``rows`` and ``out``: the score within 0 and 1 over its result set (all rows, or each ``partition``); equal scores are 0.5.

    The bounds are aggregated, written and joined back, so that a large set is a
    join that can be split and not one window.
    """
    low, high = F.min(score).alias("__low"), F.max(score).alias("__high")
    if partition:
        bounds = stored(rows.groupBy(*partition).agg(low, high))
        keys = [F.col(f"r.{p}").eqNullSafe(F.col(f"b.{p}")) for p in partition]
        joined = rows.alias("r").join(bounds.alias("b"), reduce(lambda x, y: x & y, keys)).select("r.*", "__low", "__high")
    else:
        joined = rows.crossJoin(F.broadcast(rows.agg(low, high)))  # one row
    span = F.col("__high") - F.col("__low")
    return joined.withColumn(out, F.when(span < 1e-9, 0.5).otherwise((F.col(score) - F.col("__low")) / span)).drop("__low", "__high")


def composite(rows: DataFrame, hint: str, now: Column, weights: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``rows`` (score ``semantic_score``, ``diversity``, url, timestamp, content_type, authority_score) and ``composite_score``."""
    wr, wa, wf, wd = weights or WEIGHTS.get(hint, GENERAL_WEIGHTS)
    bounds = rows.agg(F.min("semantic_score").alias("low"), F.max("semantic_score").alias("high"))
    scored = with_authority(rows.crossJoin(F.broadcast(bounds)))  # bounds is one row
    span = F.col("high") - F.col("low")
    signals = scored.withColumns(
        {
            "relevance": F.when(span < 1e-9, 0.5).otherwise((F.col("semantic_score") - F.col("low")) / span),
            "authority": F.greatest("authority_score", "authority"),
            "freshness": dates.freshness(dates.parse(F.col("timestamp")), F.coalesce("content_type", F.lit(hint)), now),
        }
    ).drop("low", "high")
    # known authorities are decimals, and so is their share: a sum may lie halfway between two roundings
    share = F.round(wa * F.col("authority"), 12)
    total = wr * F.col("relevance") + share + wf * F.col("freshness") + wd * F.col("diversity")
    return signals.withColumn("composite_score", total)


def diversity(rows: DataFrame, cluster: str = "cluster", pos: str = "pos") -> DataFrame:
    """``rows`` and ``diversity``: the k-th member (from 0) of a cluster of several gets 1 - k / largest cluster.

    Rows without a cluster name are one cluster.
    """
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("members"))
    largest = sizes.agg(F.greatest(F.max("members"), F.lit(2)).alias("largest"))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(pos)) - 1
    same = F.col(f"r.{cluster}").eqNullSafe(F.col(f"s.{cluster}"))
    joined = rows.withColumn("place", place).alias("r").join(sizes.alias("s"), same).select("r.*", "members").crossJoin(F.broadcast(largest))  # one row
    return joined.withColumn("diversity", F.when(F.col("members") == 1, 1.0).otherwise(1 - F.col("place") / F.col("largest"))).drop("place", "members", "largest")


def rank_social(items: DataFrame, query: str, platform: str, k: int | None = None, title: str = "title", body: str = "body", ts: str | None = None) -> DataFrame:
    """3 for a term in the title, 1 in the body; the whole phrase counts by platform.  Ties: newest, then input order."""
    # Phrase bonus in (title, body).
    bonus = {"reddit": (5, 0), "discord": (0, 5), "instagram": (5, 2)}[platform]
    t, b = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (title, body))
    score = F.lit(0)
    for term in dict.fromkeys(query.lower().split()):
        score = score + F.when(t.contains(term), 3).otherwise(0) + F.when(b.contains(term), 1).otherwise(0)
    phrase = query.lower().strip()
    score = score + F.when(t.contains(phrase), bonus[0]).otherwise(0) + F.when(b.contains(phrase), bonus[1]).otherwise(0)
    ranked = items.withColumn("social_score", score)
    if k is None:
        return ranked
    return ranked.orderBy(F.desc("social_score"), *([F.desc_nulls_last(ts)] if ts else []), F.asc("pos")).limit(k)
