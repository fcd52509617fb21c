"""Queries on end-to-end pipelines and provider payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import payloads
from . import pipelines, sql
from .common import CAND, QUERY, candidates, host_sql, now, query, table
from .q_rank import RECENCY, _freshness_sql, authority_sql, bm25f_sql, quality_sql

@query("web_search_snippets", f"""WITH {CAND}, {bm25f_sql(QUERY, ('title', 'snippet', 'url'))},
ini AS (SELECT cand.*, coalesce(bm25f, 0) * (0.8 + 0.2 * {quality_sql('source')}) * (1 + 0.2 * {RECENCY}) AS s FROM cand LEFT JOIN scored ON key = pos)
SELECT CAST(row_number() OVER (ORDER BY s DESC, pos) AS INTEGER) AS rank, title, snippet AS summary, url, source, round(CAST(s AS DOUBLE), 4) AS score FROM ini ORDER BY rank LIMIT 10""")
def web_search_snippets(spark, d):
    rows = candidates(spark, d)
    return pipelines.search([rows, rows.withColumn("source", F.lit("duckduckgo"))], QUERY, now())


@query("web_search_content")
def web_search_content(spark, d):
    rows = candidates(spark, d)
    return pipelines.search([rows], QUERY, now(), with_content=True).select("pos", "title", "word_count", F.round("content_quality_score", 4).alias("content_quality_score"))


_RERANKED = """{rows_sql},
ord AS (SELECT r.*, row_number() OVER (ORDER BY round(coalesce(bm25f, 0), 9) DESC, pos) AS semantic_rank FROM {rows} r LEFT JOIN scored ON key = pos),
{clusters},
oth AS (SELECT cluster, string_agg(url, ' ' ORDER BY semantic_rank) AS duplicates FROM cluster_of c JOIN ord ON c.pos = semantic_rank WHERE semantic_rank <> cluster AND url <> '' GROUP BY cluster),
kept AS (SELECT ord.*, 1.0 / (60 + semantic_rank) AS exact_score, round(1.0 / (60 + semantic_rank), 6) AS semantic_score, coalesce(duplicates, '') AS duplicates FROM cluster_of c JOIN ord ON c.pos = semantic_rank LEFT JOIN oth USING (cluster) WHERE semantic_rank = cluster)"""


@query(
    "semantic_rerank",
    f"WITH RECURSIVE {CAND}, {_RERANKED.format(rows='cand', rows_sql=bm25f_sql(QUERY), clusters=sql.near_duplicates('ord', 'semantic_rank'))} SELECT pos, CAST(semantic_rank AS INTEGER) AS semantic_rank, CAST(semantic_score AS DOUBLE) AS semantic_score, duplicates FROM kept",
)
def semantic_rerank(spark, d):
    return pipelines.semantic_rerank(candidates(spark, d), QUERY).select("pos", "semantic_rank", "semantic_score", F.array_join("duplicates", " ").alias("duplicates"))


_MERGED = f"""{CAND}, own AS (SELECT pos + (SELECT max(pos) + 1 FROM cand) AS pos, title, snippet, '' AS content, 'https://openalex.org/' || pos AS url, 'academic' AS content_type, publish_date, 0.7 AS authority_score FROM cand),
uni AS (SELECT pos, title, snippet, content, url, content_type, publish_date, 0.0 AS authority_score FROM cand UNION ALL SELECT * FROM own),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS k FROM uni) WHERE k = 1)"""


@query(
    "merged_and_ranked",
    f"""WITH RECURSIVE {_MERGED}, {_RERANKED.format(rows='once', rows_sql=bm25f_sql(QUERY, source='once'), clusters=sql.near_duplicates('ord', 'semantic_rank'))},
lim AS (SELECT min(semantic_score) AS low, max(semantic_score) AS high FROM kept),
fin AS (SELECT pos, url, 0.40 * CASE WHEN high - low < 1e-9 THEN 0.5 ELSE (semantic_score - low) / (high - low) END + 0.25 * greatest(authority_score, {authority_sql(host_sql('url'))}) + 0.15 * {_freshness_sql()} + 0.20 AS composite_score FROM kept CROSS JOIN lim)
SELECT pos, url, round(CAST(composite_score AS DOUBLE), 6) AS composite_score FROM fin ORDER BY composite_score DESC, pos LIMIT 20""",
)
def merged_and_ranked(spark, d):
    rows = candidates(spark, d)
    own = rows.select("pos", F.lit("openalex").alias("source"), F.concat(F.lit("https://openalex.org/"), F.col("pos").cast("string")).alias("url"), "title", "snippet", F.lit("academic").alias("content_type"), F.col("publish_date").alias("timestamp"), F.lit(0.7).alias("authority_score"))
    return pipelines.merge_and_rank(QUERY, rows, own, now()).select("pos", "url", F.round("composite_score", 6).alias("composite_score"))


@query("source_search_fallback", f"""WITH {CAND}, r AS (SELECT pos, url, snippet, CAST(pos % 10 AS DOUBLE) / 10 AS authority_score FROM cand) SELECT pos FROM r ORDER BY authority_score DESC, length(snippet) DESC, pos LIMIT 20""")
def source_search_fallback(spark, d):
    rows = candidates(spark, d).withColumn("authority_score", (F.col("pos") % 10).cast("double") / 10)
    return pipelines.source_search(QUERY, rows, now(), semantic=False).select("pos")


@query(
    "media_search",
    f"""WITH {CAND}, fit AS (SELECT *, 'https://img.example.org/' || (pos % 97) AS image_url FROM cand WHERE pos * 37 % 2000 >= 300), {bm25f_sql(QUERY, ('title', 'snippet', 'url'), 'fit')},
ini AS (SELECT fit.*, coalesce(bm25f, 0) * (0.8 + 0.2 * {quality_sql('source')}) * (1 + 0.2 * {RECENCY}) AS s FROM fit LEFT JOIN scored ON key = pos ORDER BY s DESC, pos LIMIT 60),
once AS (SELECT *, row_number() OVER (PARTITION BY image_url ORDER BY s DESC, pos) AS k FROM ini)
SELECT CAST(row_number() OVER (ORDER BY s DESC, pos) AS INTEGER) AS position, pos, image_url FROM once WHERE k = 1 ORDER BY position LIMIT 20""",
)
def media_search(spark, d):
    rows = candidates(spark, d).withColumn("width", (F.col("pos") * 37 % 2000).cast("int")).withColumn("image_url", F.concat(F.lit("https://img.example.org/"), (F.col("pos") % 97).cast("string")))
    return pipelines.media_search(rows, QUERY, now(), "image_url", min_width=300).select("position", "pos", "image_url")


@query("extraction_metrics", """WITH r AS (SELECT doc_id, (doc_id % 5 <> 0) AS ok, round((doc_id % 100) / 100.0, 2) AS c, n_chars AS w FROM documents)
SELECT count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE ok AND c > 0.75) AS high_quality, round(CAST(avg(c) FILTER (WHERE ok) AS DOUBLE), 4) AS avg_confidence, CAST(sum(w) FILTER (WHERE ok) AS BIGINT) AS total_words FROM r""")
def extraction_metrics(spark, d):
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 5 != 0, "success").otherwise("failed").alias("extraction_status"), F.round((F.col("doc_id") % 100) / 100, 2).alias("confidence_score"), F.col("n_chars").alias("content_word_count"))
    return pipelines.extraction_metrics(rows)


@query("reddit_posts", """SELECT conv_id, CAST(turn AS INTEGER) AS n, role AS author, 'https://www.reddit.com/r/x/' || conv_id || '_' || turn AS url, CAST(length(text) AS BIGINT) AS score FROM conversations WHERE turn >= 0""")
def reddit_posts(spark, d):
    post = F.struct(F.struct(F.col("role").alias("author"), F.concat(F.lit("/r/x/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("permalink"), F.length("text").alias("score"), F.col("text").alias("selftext")).alias("data"))
    listing = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("turn", post.alias("p")))), lambda x: x["p"]).alias("children")).alias("data"))).alias("payload"))
    return payloads.reddit_posts(listing, "payload", "conv_id").select("conv_id", "n", "author", "url", "score")


@query("platform_envelopes", "SELECT role AS platform, 'q' AS query, count(*) AS result_count FROM conversations GROUP BY role")
def platform_envelopes(spark, d):
    rows = table(spark, d, "conversations").select(F.col("role").alias("platform"), F.col("text").alias("content"), "conv_id", "turn")
    return payloads.envelopes(payloads.items(rows), "q")


@query("file_types", """WITH p AS (SELECT p_partkey, lower((['src/Main.py', 'README.MD', 'Dockerfile', 'data/x.csv', 'noext', 'a.b/c.unknown'])[p_partkey % 6 + 1]) AS f FROM part)
SELECT p_partkey, CASE f WHEN 'src/main.py' THEN 'code' WHEN 'readme.md' THEN 'markdown' WHEN 'dockerfile' THEN 'dockerfile' WHEN 'data/x.csv' THEN 'data' ELSE 'unknown' END AS file_type FROM p""")
def file_types(spark, d):
    path = F.element_at(F.array(*[F.lit(x) for x in ("src/Main.py", "README.MD", "Dockerfile", "data/x.csv", "noext", "a.b/c.unknown")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", payloads.file_type(path).alias("file_type"))


@query("robots_filter", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages) SELECT page_id, NOT starts_with(path, '/en') AS allowed FROM p""")
def robots_filter(spark, d):
    from ..functions.urls import host

    pages = table(spark, d, "pages").select("page_id", "url")
    rules = pages.select(host(F.col("url")).alias("host"), F.lit("/en").alias("disallow")).distinct()
    return payloads.robots_allowed(pages, rules).select("page_id", "allowed")
