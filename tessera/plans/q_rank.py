"""Queries on ranking, fusion and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, query as P
from ..operators import bm25f, dedup, ranking, vectors
from . import sql
from .common import AGE, CAND, OPERATORS, QUERY, candidates, count_sql, duck_stem, host_sql, now, query, table, tokens_sql, words_sql

_W = bm25f.Settings()


def bm25f_sql(text: str, fields: tuple[str, ...] = ("title", "snippet", "content", "url"), source: str = "cand", key: str = "pos") -> str:
    """CTEs that end in ``scored(key, bm25f)`` with the exact, fuzzy and phrase rules over ``source``."""
    order = P.stems(text)
    terms = list(dict.fromkeys(order))
    long = " UNION ALL ".join(f"SELECT {key} AS key, '{f}' AS field, {tokens_sql(f)} AS tokens FROM {source}" for f in fields)
    values = ", ".join(f"('{t}')" for t in terms)
    fuzzy = " OR ".join(f"levenshtein(term, '{t}') = 1" + (f" OR starts_with(term, '{t}')" if len(t) >= 4 else "") for t in terms)
    steps = ", ".join(f"({i}, '{t}')" for i, t in enumerate(order))
    weight = "CASE field " + " ".join(f"WHEN '{f}' THEN {_W.weights[f]}" for f in fields) + " END"
    boost = "CASE WHEN p.key IS NOT NULL THEN 2.0 ELSE 1.0 END" if len(order) > 1 else "1.0"
    return rf"""
fld AS ({long}),
stats AS (SELECT field, count(*) AS n, avg(len(tokens)) AS mean FROM fld GROUP BY field),
tok AS (SELECT key, field, len(tokens) AS dl, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS spot FROM fld),
stm AS (SELECT key, field, dl, spot, {duck_stem('token')} AS term FROM tok),
hit AS (SELECT * FROM stm WHERE term IN ({", ".join(f"'{t}'" for t in terms)}) OR {fuzzy}),
post AS (SELECT key, field, dl, term, count(*) AS tf FROM hit GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
part AS (SELECT key, field, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / CASE WHEN mean > 0 THEN mean ELSE 1 END)) AS part FROM post JOIN dfs USING (field, term) JOIN stats USING (field)),
q(q) AS (VALUES {values}),
m AS (SELECT key, field, q, max(CASE WHEN term = q THEN part END) AS exact,
  max(CASE WHEN term = q THEN NULL WHEN length(q) >= 4 AND starts_with(term, q) THEN part WHEN levenshtein(term, q) = 1 THEN part * (1 - 1.0 / greatest(length(term), length(q))) END) AS fuzzy FROM part CROSS JOIN q GROUP BY ALL),
pf AS (SELECT key, field, sum(coalesce(exact, fuzzy * 0.5)) AS score FROM m WHERE exact IS NOT NULL OR fuzzy IS NOT NULL GROUP BY ALL),
st(i, q) AS (VALUES {steps}),
ph AS (SELECT DISTINCT key, field FROM (SELECT key, field, spot - i AS start, count(*) AS n FROM hit JOIN st ON term = q GROUP BY ALL) WHERE n = {len(order)}),
scored AS (SELECT pf.key, sum(score * {weight.replace('field', 'pf.field')} * {boost}) AS bm25f FROM pf LEFT JOIN ph p ON p.key = pf.key AND p.field = pf.field GROUP BY pf.key)"""


@query("bm25f_scores", f"WITH {CAND}, {bm25f_sql(QUERY)} SELECT key AS pos, round(bm25f, 6) AS bm25f FROM scored")
def bm25f_scores(spark, d):
    return bm25f.scores(candidates(spark, d), QUERY).withColumn("bm25f", F.round("bm25f", 6))


@query("bm25f_phrase_fuzzy", f"WITH {CAND}, {bm25f_sql('of the thin')} SELECT key AS pos, round(bm25f, 6) AS bm25f FROM scored")
def bm25f_phrase_fuzzy(spark, d):
    return bm25f.scores(candidates(spark, d), "of the thin").withColumn("bm25f", F.round("bm25f", 6))


@query(
    "bm25_flat",
    f"""WITH t AS (SELECT doc_id AS pos, {tokens_sql('text')} AS tokens FROM documents), s AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM t),
u AS (SELECT pos, len(tokens) AS dl, unnest(tokens) AS term FROM t), f AS (SELECT pos, dl, term, count(*) AS tf FROM u WHERE term IN ('from', 'the', 'only', 'with') GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT pos, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS bm25 FROM f JOIN g USING (term) CROSS JOIN s GROUP BY pos""",
)
def bm25_flat(spark, d):
    return bm25f.flat_scores(candidates(spark, d), QUERY).withColumn("bm25", F.round("bm25", 6))


def quality_sql(source: str) -> str:
    exact = " ".join(f"WHEN lower({source}) = '{k}' THEN {v}" for k, v in ranking.SOURCE_QUALITY)
    prefix = " ".join(f"WHEN starts_with(lower({source}), '{k}') THEN {v}" for k, v in ranking.SOURCE_QUALITY)
    return f"(CASE {exact} {prefix} ELSE 0.80 END)"


RECENCY = f"(CASE WHEN {AGE} < 24 THEN 1.0 WHEN {AGE} < 168 THEN 0.8 WHEN {AGE} < 720 THEN 0.5 ELSE 0.2 END)"
_INITIAL = f"""{CAND}, {bm25f_sql(QUERY, ('title', 'snippet', 'url'))},
ini AS (SELECT cand.*, coalesce(bm25f, 0) * (0.8 + 0.2 * {quality_sql('source')}) * (1 + 0.2 * {RECENCY}) AS initial_rank_score FROM cand LEFT JOIN scored ON key = pos)"""


@query("initial_ranking", f"WITH {_INITIAL} SELECT pos, round(CAST(initial_rank_score AS DOUBLE), 6) AS initial_rank_score FROM ini")
def initial_ranking(spark, d):
    return ranking.rank_initial(candidates(spark, d), QUERY, now(), None).select("pos", F.round("initial_rank_score", 6).alias("initial_rank_score"))


def relevance_sql(text: str, parsed: P.Terms) -> tuple[str, str]:
    """(score, matches) of a text."""
    words = " + ".join(count_sql(f"lower({text})", t) for t in parsed.required) or "0"
    runs = " + ".join(count_sql(f"lower({text})", t) for t in parsed.phrases) or "0"
    barred = " OR ".join(f"contains(lower({text}), '{t}')" for t in parsed.excluded) or "false"
    return f"(CASE WHEN {barred} THEN 0.0 ELSE 10.0 * ({words}) + 20.0 * ({runs}) END)", f"(CASE WHEN {barred} THEN 0 ELSE ({words}) + ({runs}) END)"


_T, _B, _C = (relevance_sql(c, P.parse(OPERATORS)) for c in ("title", "snippet", "content"))


@query("legacy_ranking", f"WITH {CAND} SELECT pos, round(CAST(3 * {_T[0]} + 2 * {_B[0]} + 10 * {quality_sql('source')} + 15 * {RECENCY} AS DOUBLE), 6) AS score, CAST({_T[1]} + {_B[1]} AS INTEGER) AS match_count FROM cand")
def legacy_ranking(spark, d):
    return ranking.rank_legacy(candidates(spark, d), OPERATORS, now(), None).select("pos", F.round("initial_rank_score", 6).alias("score"), "match_count")


def _final_sql(source: str, terms: P.Terms) -> str:
    score, matches = relevance_sql("content", terms)
    from ..operators.quality import BLOCKED, PAYWALL

    marks = "|".join(x.replace(".", r"\.") for x in BLOCKED + PAYWALL)
    quality = f"CASE WHEN content <> '' THEN 5.0 ELSE 0 END + CASE WHEN length(content) > 500 THEN 3.0 ELSE 0 END + CASE WHEN content <> '' AND regexp_matches(lower(content), '{marks}') THEN 0 ELSE 2.0 END"
    density = f"coalesce(100.0 * {matches} / nullif({words_sql('content')}, 0), 0)"
    return f"SELECT pos, initial_rank_score + 3 * {score} + {quality} + 0.5 * least({density}, 10.0) AS final_rank_score FROM {source}"


@query(
    "bm25f_staged_top10",
    f"WITH {_INITIAL}, top AS (SELECT * FROM ini ORDER BY initial_rank_score DESC, pos LIMIT 15), fin AS ({_final_sql('top', P.parse(QUERY))}) SELECT pos, round(CAST(final_rank_score AS DOUBLE), 4) AS final_rank_score FROM fin ORDER BY final_rank_score DESC, pos LIMIT 10",
)
def bm25f_staged_top10(spark, d):
    out = ranking.staged(candidates(spark, d), QUERY, now(), lambda rows: rows)
    return out.select("pos", F.round("final_rank_score", 4).alias("final_rank_score"))


@query("final_ranking", f"WITH {CAND}, c0 AS (SELECT *, 0.0 AS initial_rank_score FROM cand), fin AS ({_final_sql('c0', P.parse(OPERATORS))}) SELECT pos, round(CAST(final_rank_score AS DOUBLE), 6) AS final_rank_score FROM fin")
def final_ranking(spark, d):
    rows = candidates(spark, d).withColumn("initial_rank_score", F.lit(0.0))
    return ranking.rank_final(rows, OPERATORS, None).select("pos", F.round("final_rank_score", 6).alias("final_rank_score"))


def authority_sql(domain: str) -> str:
    return "(CASE " + domain + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranking.AUTHORITY.items()) + " ELSE 0.5 END)"


@query(
    "authority_scores",
    f"""WITH {CAND}, dom AS (SELECT pos, {host_sql('url')} AS domain FROM cand), adj AS (SELECT domain, 1.0 + count(*) FILTER (WHERE pos % 3 <> 0) AS alpha, 1.0 + count(*) FILTER (WHERE pos % 3 = 0) AS beta FROM dom GROUP BY domain)
SELECT pos, domain, round(CAST(greatest(0.0, least(1.0, {authority_sql('domain')} + (alpha / (alpha + beta) - 0.5) * least((alpha + beta - 2) / 20, 1.0))) AS DOUBLE), 6) AS authority FROM dom JOIN adj USING (domain)""",
)
def authority_scores(spark, d):
    from ..functions.urls import host
    from ..operators.state import authority_counters

    rows = candidates(spark, d).select("pos", "url")
    log = rows.select(host(F.col("url")).alias("host"), (F.col("pos") % 3 != 0).alias("ok"))
    return ranking.with_authority(rows, adjustments=authority_counters(log, "host", "ok")).select("pos", "domain", F.round("authority", 6).alias("authority"))


def _freshness_sql() -> str:
    life = "CASE content_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dates.HALF_LIFE.items()) + " ELSE 720.0 END"
    return f"pow(0.5, {AGE} / ({life}))"


@query("freshness_scores", f"WITH {CAND} SELECT pos, content_type, round({_freshness_sql()}, 6) AS freshness FROM cand")
def freshness_scores(spark, d):
    return candidates(spark, d).select("pos", "content_type", F.round(dates.freshness(dates.parse(F.col("publish_date")), F.col("content_type"), now()), 6).alias("freshness"))


def _composite_sql(hint: str) -> str:
    wr, wa, wf, wd = ranking.WEIGHTS[hint]
    return f"""WITH {CAND}, {bm25f_sql(QUERY)}, s AS (SELECT cand.*, coalesce(bm25f, 0) AS semantic_score, {host_sql('url')} AS domain FROM cand LEFT JOIN scored ON key = pos),
b AS (SELECT min(semantic_score) AS low, max(semantic_score) AS high FROM s),
k AS (SELECT pos, row_number() OVER (PARTITION BY sha256(content) ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY sha256(content)) AS members FROM cand),
l AS (SELECT greatest(max(members), 2) AS largest FROM k)
SELECT pos, round(CAST({wr} * CASE WHEN high - low < 1e-9 THEN 0.5 ELSE (semantic_score - low) / (high - low) END + {wa} * {authority_sql('domain')} + {wf} * {_freshness_sql()}
 + {wd} * CASE WHEN members = 1 THEN 1.0 ELSE 1 - place / largest END AS DOUBLE), 6) AS composite_score
FROM s JOIN k USING (pos) CROSS JOIN b CROSS JOIN l"""


@query("composite_scores", _composite_sql("news"))
def composite_scores(spark, d):
    rows = candidates(spark, d)
    semantic = rows.join(bm25f.scores(rows, QUERY), "pos", "left").withColumn("semantic_score", F.coalesce("bm25f", F.lit(0.0)))
    clustered = semantic.withColumn("cluster", F.sha2("content", 256))
    spread = ranking.diversity(clustered).withColumn("timestamp", F.col("publish_date")).withColumn("authority_score", F.lit(0.0))
    return ranking.composite(spread, "news", now()).select("pos", F.round("composite_score", 6).alias("composite_score"))


@query(
    "knn_top20",
    """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(CAST(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS DOUBLE), 6) AS similarity FROM embeddings CROSS JOIN q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) DESC, vec_id LIMIT 20""",
)
def knn_top20(spark, d):
    rows = table(spark, d, "embeddings")
    vector = rows.where("vec_id = 0").select("embedding").first()["embedding"]
    return vectors.knn(rows, vector, 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    "rrf_fusion",
    f"""WITH {CAND}, {bm25f_sql(QUERY)}, a AS (SELECT key AS pos, row_number() OVER (ORDER BY bm25f DESC, key) AS rank FROM scored ORDER BY rank LIMIT 50),
b AS (SELECT pos, row_number() OVER (ORDER BY publish_date DESC, pos) AS rank FROM cand ORDER BY rank LIMIT 50)
SELECT pos, round(CAST(sum(1.0 / (60 + rank)) AS DOUBLE), 6) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY pos""",
)
def rrf_fusion(spark, d):
    rows = candidates(spark, d)
    lexical = ranking.with_rank(bm25f.scores(rows, QUERY), "bm25f", limit=50)
    fresh = ranking.with_rank(rows.select("pos", "publish_date"), "publish_date", limit=50)
    return ranking.fuse(lexical, fresh).select("pos", F.round("rrf", 6).alias("rrf"))


@query(
    "query_cache_lookup",
    """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), last AS (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 100)
SELECT vec_id FROM last CROSS JOIN q WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) >= 0.2 ORDER BY vec_id DESC LIMIT 1""",
)
def query_cache_lookup(spark, d):
    rows = table(spark, d, "embeddings")
    vector = rows.where("vec_id = 0").select("embedding").first()["embedding"]
    return vectors.cache_lookup(rows, vector, "embedding", "vec_id", least=0.2).select("vec_id")


@query(
    "chunk_index",
    f"""WITH {CAND}, c AS (SELECT pos, url, content, CASE WHEN length(content) <= 500 THEN [0] ELSE range(0, length(content), 450) END AS starts FROM cand WHERE length(content) > 0),
e AS (SELECT pos, url, content, unnest(starts) AS s, generate_subscripts(starts, 1) - 1 AS chunk_idx FROM c)
SELECT md5(url || '|' || chunk_idx) AS id, pos, CAST(chunk_idx AS INTEGER) AS chunk_idx, substring(sha256(substring(content, CAST(s AS INTEGER) + 1, 500)), 1, 16) AS content_hash FROM e""",
)
def chunk_index(spark, d):
    return vectors.chunk_index(candidates(spark, d), "pos").select("id", "pos", "chunk_idx", "content_hash")


@query(
    "hybrid_search",
    f"""WITH {CAND}, qv AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 1),
near AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS similarity FROM embeddings CROSS JOIN qv ORDER BY 2 DESC, 1 LIMIT 30),
found AS (SELECT pos, title, content AS snippet, content, url, similarity FROM cand JOIN near ON pos = vec_id), {bm25f_sql(QUERY, source='found')},
ranks AS (SELECT pos, row_number() OVER (ORDER BY coalesce(bm25f, 0) DESC, pos) AS rank FROM found LEFT JOIN scored ON key = pos UNION ALL SELECT pos, row_number() OVER (ORDER BY similarity DESC, pos) FROM found),
fused AS (SELECT pos, sum(1.0 / (60 + rank)) AS rrf FROM ranks GROUP BY pos ORDER BY rrf DESC, pos LIMIT 10),
once AS (SELECT pos AS vec_id, url, rrf, row_number() OVER (PARTITION BY url ORDER BY rrf DESC, pos) AS k FROM fused JOIN found USING (pos))
SELECT vec_id, url, round(CAST(rrf AS DOUBLE), 6) AS rrf FROM once WHERE k = 1""",
)
def hybrid_search(spark, d):
    docs = candidates(spark, d).select(F.col("pos").alias("vec_id"), "title", "url", F.col("content").alias("text"))
    rows = table(spark, d, "embeddings")
    vector = rows.where("vec_id = 1").select("embedding").first()["embedding"]
    return vectors.hybrid(docs, rows, QUERY, vector).select("vec_id", "url", F.round("rrf", 6).alias("rrf"))


@query(
    "social_ranking",
    f"""SELECT conv_id, turn, CAST(CASE WHEN contains(lower(role), 'the') THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(role), 'from') THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), 'from') THEN 1 ELSE 0 END
 + CASE WHEN contains(lower(role), 'from the') THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), 'from the') THEN 2 ELSE 0 END AS INTEGER) AS social_score FROM conversations""",
)
def social_ranking(spark, d):
    return ranking.rank_social(table(spark, d, "conversations"), "from the", "instagram", title="role", body="text").select("conv_id", "turn", "social_score")


@query(
    "min_max_by_source",
    """SELECT doc_id, round(CAST(CASE WHEN max(n_chars) OVER w - min(n_chars) OVER w < 1e-9 THEN 0.5 ELSE CAST(n_chars - min(n_chars) OVER w AS DOUBLE) / (max(n_chars) OVER w - min(n_chars) OVER w) END AS DOUBLE), 6) AS scaled FROM documents WINDOW w AS (PARTITION BY source)""",
)
def min_max_by_source(spark, d):
    return ranking.min_max(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "n_chars", "scaled", "source").select("doc_id", F.round("scaled", 6).alias("scaled"))


@query("near_duplicate_clusters", f"WITH RECURSIVE {CAND}, {sql.near_duplicates('cand', 'pos')} SELECT pos, cluster FROM cluster_of")
def near_duplicate_clusters(spark, d):
    return dedup.clusters(candidates(spark, d)).select("pos", "cluster")


@query(
    "near_duplicate_survivors",
    f"WITH RECURSIVE {CAND}, {sql.near_duplicates('cand', 'pos')}, o AS (SELECT cluster, string_agg(url, ' ' ORDER BY pos) AS duplicates FROM cluster_of JOIN cand USING (pos) WHERE pos <> cluster GROUP BY cluster) "
    "SELECT pos, coalesce(duplicates, '') AS duplicates FROM cluster_of LEFT JOIN o USING (cluster) WHERE pos = cluster",
)
def near_duplicate_survivors(spark, d):
    return dedup.collapse(candidates(spark, d)).select("pos", F.array_join("duplicates", " ").alias("duplicates"))
