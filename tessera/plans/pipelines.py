"""End-to-end entry points: discovery tables in, ranked or extracted results out.

Expensive steps (content extraction, models) stand behind a limit in each plan,
since the optimizer does not move a UDF above a top-k by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import bm25f, dedup, documents, facets, ingest, quality, ranking
from ..operators.graph import cut

Step = Callable[[DataFrame], DataFrame]


def discover(*streams: DataFrame, url: str = "url") -> DataFrame:
    """Union of streams in order, first wins by URL; rows without one go.  ``pos`` is renewed as (stream, place)."""
    parts = [s.withColumn("stream", F.lit(i)) for i, s in enumerate(streams)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return dedup.first_wins(every, F.col(url), "stream", "pos")


def resolve_wrappers(rows: DataFrame, url: str = "url") -> DataFrame:
    """Wrapper URLs become their publisher's, or go where it is not named; what another row has already goes too."""
    wrapped = urls.is_wrapper(F.col(url))
    named = rows.withColumn("was_resolved", wrapped).withColumn(url, F.when(wrapped, urls.resolve(F.col(url), F.lit(""))).otherwise(F.col(url)))
    return dedup.first_wins(named.where(F.col(url).isNotNull()), F.col(url), "was_resolved", "pos")


def snippets(ranked: DataFrame, k: int) -> DataFrame:
    return ranking.with_rank(ranked, "initial_rank_score", limit=k).select("rank", "title", F.col("snippet").alias("summary"), "url", "source", F.round("initial_rank_score", 4).alias("score"))


def search(streams: list[DataFrame], query: str, now: Column, k: int = 10, extract: Step | None = None, with_content: bool = False) -> DataFrame:
    """Web or news search: discover, resolve, rank on metadata, then snippets or extraction and cleaning of the top ``k``."""
    found = discover(*streams)
    ranked = ranking.rank_initial(found if not with_content else resolve_wrappers(found), query, now, k)
    if not with_content:
        return snippets(ranked, k)
    extracted = (extract or (lambda rows: rows))(ranked)
    structured = documents.structured(extracted, "pos", "content", "url")
    joined = ranked.select("pos", "title", "url", "source", "initial_rank_score").join(structured, "pos")
    return joined.orderBy(F.desc("content_quality_score"), "pos")


def semantic_rerank(rows: DataFrame, query: str, vector_rank: DataFrame | None = None, cross_encoder: Column | None = None, top: int = 20, collapse: bool = True) -> DataFrame:
    """BM25F ranks, with vector ranks (pos, rank) if given, fused; a model score reorders the first ``top``; near-duplicates collapse."""
    scored = rows.select("pos").join(bm25f.scores(rows, query), "pos", "left").select("pos", F.round(F.coalesce("bm25f", F.lit(0.0)), 9).alias("bm25f"))  # sums differ in their last digits with the order of arrival: equal texts have to tie
    lexical = ranking.with_rank(scored, "bm25f")
    fused = ranking.fuse(*([lexical] if vector_rank is None else [lexical, vector_rank]))
    ordered = rows.join(ranking.with_rank(fused, "rrf").select("pos", F.col("rank").alias("semantic_rank"), F.round("rrf", 6).alias("semantic_score")), "pos")
    if cross_encoder is not None:
        first = ordered.where(F.col("semantic_rank") <= top).withColumn("__model", cross_encoder)
        rest = ordered.where(F.col("semantic_rank") > top).withColumn("reranked", F.lit(False))
        first = ranking.with_rank(first, "__model", limit=top).drop("semantic_rank", "__model").withColumnRenamed("rank", "semantic_rank").withColumn("reranked", F.lit(True))
        ordered = first.unionByName(rest)
    if not collapse:
        return ordered
    # the collapse keeps the first of a cluster: first by rank
    return dedup.collapse(cut(ordered).withColumnRenamed("pos", "__own").withColumnRenamed("semantic_rank", "pos"), "pos").withColumnRenamed("pos", "semantic_rank").withColumnRenamed("__own", "pos")


def with_facets(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results and, separately, their facets."""
    return ranked, facets.facets(ranked)


def merge_and_rank(query: str, regular: DataFrame, sources: DataFrame | None, now: Column, k: int = 20, hint: str = "web") -> DataFrame:
    """Unified records of both kinds, first wins by URL (rows without one stay), semantic then composite ranking."""
    every = ingest.unified(regular)
    if sources is not None:
        offset = regular.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("o"))  # one row
        own = sources.crossJoin(F.broadcast(offset)).withColumn("pos", F.col("pos") + F.col("o")).drop("o")
        every = every.unionByName(own.select(*[c for c in every.columns if c in own.columns]), allowMissingColumns=True)
    once = dedup.first_wins(every, F.col("url"), "pos", keep_empty=True)
    semantic = semantic_rerank(once, query).withColumn("diversity", F.lit(1.0))
    return bm25f.top(ranking.composite(semantic, hint, now), "composite_score", k)


def source_search(query: str, records: DataFrame, now: Column, k: int = 20, semantic: bool = True) -> DataFrame:
    """Records of plugins: rows without a URL go; ranked, or ordered by authority and snippet length."""
    once = dedup.first_wins(records, F.col("url"), "pos")
    if not semantic:
        return once.orderBy(F.desc("authority_score"), F.desc(F.length("snippet")), "pos").limit(k)
    ranked = semantic_rerank(once.withColumn("content", F.coalesce("content", F.lit("")) if "content" in once.columns else F.lit("")), query)
    return bm25f.top(ranking.composite(ranked.withColumn("diversity", F.lit(1.0)), "web", now), "composite_score", k)


def media_search(rows: DataFrame, query: str, now: Column, key: str, k: int = 20, **bounds: int | None) -> DataFrame:
    """Images or videos: bounds, ranking, then first wins by media URL (title where it is missing), renumbered."""
    from ..operators.feeds import by_dimensions

    fit = by_dimensions(rows, **bounds) if bounds else rows
    ranked = ranking.rank_initial(fit, query, now, 3 * k)
    once = dedup.first_wins(ranked, ingest.filled(key, "title"), F.desc("initial_rank_score"), "pos")
    return ranking.with_rank(once, "initial_rank_score", limit=k).withColumnRenamed("rank", "position")


def extraction_metrics(rows: DataFrame) -> DataFrame:
    """One row: successes, high-quality results, mean confidence, words."""
    ok = F.col("extraction_status") == "success"
    return rows.agg(F.count_if(ok).alias("successful"), F.count_if(ok & (F.col("confidence_score") > 0.75)).alias("high_quality"), F.round(F.avg(F.when(ok, F.col("confidence_score"))), 4).alias("avg_confidence"), F.sum(F.when(ok, F.col("content_word_count"))).alias("total_words"))


def classify_and_augment(query: str, regular: DataFrame, landed: DataFrame, chosen: DataFrame, now: Column, k: int = 20) -> DataFrame:
    """Source augmentation: the sources chosen for the query's type, their records, merged and ranked."""
    from ..sources.plugins import search_all

    names = [r["source_name"] for r in chosen.where(F.col("query_type") == quality.classify_query(F.lit(query))).select("source_name").distinct().collect()]  # a registry of some dozens
    return merge_and_rank(query, regular, search_all(landed, names=sorted(names)) if names else None, now, k)
