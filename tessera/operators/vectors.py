"""Vectors and chunks: normalisation, nearest neighbours, query cache, chunk index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bm25f, ranking

CHUNK, OVERLAP = 500, 50
CACHE_ROWS, CACHE_COSINE = 100, 0.92


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalize(v: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm(v)))


def knn(rows: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``rows`` and ``similarity`` of the ``k`` nearest to a literal ``query``; a top-k in each task, then of those."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("similarity", cosine(F.col(vector), q)).orderBy(F.desc("similarity"), F.asc(key)).limit(k)


def cache_lookup(cache: DataFrame, query: list[float], vector: str = "query_vec", ts: str = "timestamp", rows: int = CACHE_ROWS, least: float = CACHE_COSINE) -> DataFrame:
    """The most recent of the last ``rows`` cached queries with a cosine of at least ``least``: one row or none."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return cache.orderBy(F.desc(ts)).limit(rows).withColumn("similarity", cosine(F.col(vector), q)).where(F.col("similarity") >= least).orderBy(F.desc(ts)).limit(1)


def chunks(docs: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_idx, chunk): windows of ``size`` characters; empty texts have none."""
    n = F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)))
    rows = docs.where(F.coalesce(n, F.lit(0)) > 0).select(key, text, F.posexplode(starts).alias("chunk_idx", "start"))
    return rows.select(key, "chunk_idx", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk"))


def chunk_index(docs: DataFrame, key: str, *, title: str = "title", url: str = "url", source: str = "source", text: str = "content") -> DataFrame:
    """Rows of the chunk table: id, position, text, metadata, content hash."""
    cut = chunks(docs, key, text)
    meta = docs.select(key, F.coalesce(title, F.lit("")).alias("title"), F.coalesce(url, F.lit("")).alias("url"), F.coalesce(source, F.lit("")).alias("source"))
    return cut.join(meta, key).select(
        F.md5(F.concat_ws("|", "url", F.col("chunk_idx").cast("string"))).alias("id"), key, "chunk_idx", F.col("chunk").alias("text"), "title", "url", "source",
        F.substring(F.sha2("chunk", 256), 1, 16).alias("content_hash"),
    )


def hybrid(index: DataFrame, vectors: DataFrame, query: str, vector: list[float], k: int = 10, key: str = "vec_id") -> DataFrame:
    """k-NN top 3k, BM25F over those, rank fusion, top ``k``, one row for each URL.

    ``index`` has (key, title, url, text), ``vectors`` (key, embedding).  Everything
    behind the k-NN sees at most 3k rows.
    """
    near = knn(vectors, vector, 3 * k, key).select(key, "similarity")
    found = index.join(F.broadcast(near), key)  # 3k rows
    docs = found.select(F.col(key), "title", F.col("text").alias("snippet"), F.col("text").alias("content"), "url")
    lexical = docs.join(bm25f.scores(docs, query, key), key, "left").select(key, F.coalesce("bm25f", F.lit(0.0)).alias("bm25f"))
    fused = ranking.fuse(ranking.with_rank(lexical, "bm25f", key, 3 * k), ranking.with_rank(found.select(key, "similarity"), "similarity", key, 3 * k), key=key)
    from .dedup import first_wins

    top = fused.orderBy(F.desc("rrf"), F.asc(key)).limit(k)
    return first_wins(found.join(top, key), F.col("url"), F.desc("rrf"), F.asc(key))
