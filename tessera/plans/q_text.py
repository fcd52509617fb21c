"""Queries on text functions, cleaning and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import structure as S
from ..functions import text as T
from ..operators import documents as D
from ..operators import quality as Q
from . import sql
from .common import CAND, candidates, duck_stem, query, table, tokens_sql, words_sql


@query(
    "tokens_stems",
    f"""WITH t AS (SELECT unnest({tokens_sql('text')}) AS word FROM documents)
SELECT word, {duck_stem('word')} AS stem, count(*) AS n FROM t GROUP BY ALL""",
)
def tokens_stems(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", T.stem("word").alias("stem"), "n")


# For RE2, whose word boundaries are ASCII: letters beyond ASCII become _, other characters beyond it a space.
_ASCII = r"regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"


@query(
    "top_keywords_per_document",
    rf"""WITH t AS (SELECT doc_id, regexp_extract_all({_ASCII.format("lower(text)")}, '\b[a-zA-Z''][a-zA-Z''-]{{3,}}\b') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS keyword, generate_subscripts(ws, 1) AS spot FROM t),
c AS (SELECT doc_id, keyword, count(*) AS count, min(spot) AS spot FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, spot) AS place FROM c)
SELECT doc_id, keyword, count, place FROM r WHERE place <= 15""",
)
def top_keywords_per_document(spark, d):
    return D.keywords(table(spark, d, "documents"), "doc_id", "text")


# Sentences as a list: abbreviations hidden, ends in front of a capital marked and cut, abbreviations shown again.
_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(
  replace(replace(replace(replace(regexp_replace({0}, '(Dr|Mr|Mrs|Ms|Prof|etc|vs|Jan|Feb|Aug|Sept|Oct|Nov|Dec)\.', '\1#', 'g'), 'e.g.', 'e#g#'), 'i.e.', 'i#e#'), 'U.S.', 'U#S#'), 'U.K.', 'U#K#'),
  '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda x: trim(replace(replace(replace(replace(regexp_replace(x, '(Dr|Mr|Mrs|Ms|Prof|etc|vs|Jan|Feb|Aug|Sept|Oct|Nov|Dec)#', '\1.', 'g'), 'e#g#', 'e.g.'), 'i#e#', 'i.e.'), 'U#S#', 'U.S.'), 'U#K#', 'U.K.'), ' ' || chr(9) || chr(10) || chr(13))),
  lambda x: length(x) > 15)"""


@query(
    "readability",
    rf"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS ws, len({_SENTENCES.format("text")}) AS sentences FROM documents),
b AS (SELECT doc_id, len(ws) AS words, sentences, list_sum(list_transform(ws, lambda w: length(w))) AS chars,
 list_sum(list_transform(ws, lambda w: CASE WHEN length(w) <= 3 THEN 1 ELSE len(regexp_extract_all(lower(w), '[aeiouy]+')) END)) AS syllables FROM a WHERE len(ws) > 0 AND sentences > 0)
SELECT doc_id, CAST(words AS INTEGER) AS words, CAST(sentences AS INTEGER) AS sentences, CAST(syllables AS INTEGER) AS syllables, round(words / sentences + 1e-9, 1) AS avg_sentence_length,
 round(chars / words + 1e-9, 1) AS avg_word_length, round(greatest(0, 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words)) + 1e-9, 4) AS flesch FROM b""",
)
def readability(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array(T.readability(F.col("text")))).alias("r")).where(F.col("r").isNotNull())
    return rows.select("doc_id", "r.words", "r.sentences", "r.syllables", "r.avg_sentence_length", "r.avg_word_length", F.round(F.col("r.flesch") + 1e-9, 4).alias("flesch"))


@query(
    "content_hash_groups",
    r"""SELECT sha256(substring(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 5000)) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies
FROM documents GROUP BY 1""",
)
def content_hash_groups(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash")).groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


# The phrases go one after the other, each up to the end of its line, the word 'advertisement' alone.
_CLEANED = "t"
for _phrase in (
    r"home\s*\|.*", r"about\s*us.*", r"contact\s*us.*", r"sitemap.*", r"privacy\s*policy.*", r"terms\s*of\s*use.*", r"cookie\s*policy.*", r"accessibility\s*statement.*",
    r"legal\s*notice.*", r"copyright\s*©.*", r"all\s*rights\s*reserved.*", r"follow\s*us\s*on.*", r"like\s*us\s*on.*", r"share\s*this\s*page.*", r"tweet\s*this.*",
    r"sponsored\s*content.*", r"advertisement", r"promoted\s*by.*", r"partner\s*content.*",
):
    _CLEANED = f"regexp_replace({_CLEANED}, '(?i){_phrase}', '', 'g')"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: (doc_id, t): cleaned texts of {0}, a table (doc_id, text).
_CLEAN = rf"""
l AS (SELECT doc_id, string_split(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', ' ', 'g'), chr(10)) AS a FROM {{0}}),
k AS (SELECT doc_id, array_to_string(list_filter(list_transform(a, lambda x: trim(x, {_WHITE})), lambda x: NOT regexp_matches(x, '^[=*\-_~]{{3,}}$')
  AND NOT regexp_matches(x, '^\s*\d+\s*$|^Page\s+\d+') AND NOT regexp_matches(x, '^[A-Za-z]+\s*>\s*[A-Za-z]+(\s*>\s*[A-Za-z]+)*$')), chr(10)) AS t FROM l),
p AS (SELECT doc_id, string_split({_CLEANED}, chr(10)) AS a FROM k),
e AS (SELECT doc_id, len(a) AS n, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM p),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS copies, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS turn FROM e),
h AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM c
  WHERE NOT (n > 10 AND length(line) < 80 AND copies > 3 AND len(regexp_extract_all(line, '\S+')) < 5 AND turn > 1) GROUP BY doc_id),
cleaned AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), {_WHITE}) AS t FROM h)""".replace("{{", "{").replace("}}", "}")


@query("clean_text", f"WITH {_CLEAN.replace('{0}', 'documents')} SELECT doc_id, length(t) AS cleaned_chars, sha256(t) AS cleaned_sha256 FROM cleaned")
def clean_text(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array(T.clean(F.col("text")))).alias("t"))
    return rows.select("doc_id", F.length("t").alias("cleaned_chars"), F.sha2("t", 256).alias("cleaned_sha256"))


def _noisy(docs):
    """Documents with furniture between their lines, by doc_id."""
    k = F.col("doc_id") % 6
    noise = F.element_at(F.array(*[F.lit(x) for x in _NOISE]), (k + 1).cast("int"))
    return docs.select("doc_id", F.concat(noise, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"), noise, F.lit("\n\n\n\nend  of\tit\t \t.")).alias("text"))


_NOISE = (
    "Home | News | Sport\n=====\n 12 \nPage 7 of 9\nHome > News > World", "See our Privacy  Policy\n---\nfollow us on all of them\nAdvertisement here", "Menu\nMenu\nMenu\nMenu\nMenu\ntext of its own",
    "about\nus and them\nCopyright © 2024 X\r\nAll rights reserved.", "tab\x07bell\x01\nTweet this now\n****", "A > B\nContact us\n~~~\n__\nShare this page\nlegal notice",
)


@query(
    "clean_noisy_text",
    "WITH noise AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, " + " || ".join(f"chr({ord(c)})" if not c.isprintable() else f"'{c}'" for c in x) + ")" for i, x in enumerate(_NOISE))
    + ") v(k, x)), raw AS (SELECT doc_id, x || chr(10) || coalesce(text, '') || chr(10) || x || repeat(chr(10), 4) || 'end  of' || chr(9) || 'it' || chr(9) || ' ' || chr(9) || '.' AS text FROM documents JOIN noise ON doc_id % 6 = k),"
    + f"{_CLEAN.replace('{0}', 'raw')} SELECT doc_id, length(t) AS cleaned_chars, sha256(t) AS cleaned_sha256 FROM cleaned",
)
def clean_noisy_text(spark, d):
    rows = _noisy(table(spark, d, "documents")).select("doc_id", F.explode(F.array(T.clean(F.col("text")))).alias("t"))
    return rows.select("doc_id", F.length("t").alias("cleaned_chars"), F.sha2("t", 256).alias("cleaned_sha256"))


@query("paragraph_statistics", f"WITH RECURSIVE {sql.PARAGRAPHS} SELECT d.doc_id, CAST(count(p) AS INTEGER) AS paragraphs, CAST(coalesce(max(length(p)), 0) AS INTEGER) AS longest, sha256(coalesce(string_agg(p, chr(10) ORDER BY n), '')) AS paragraphs_sha256 FROM documents d LEFT JOIN paragraphs USING (doc_id) GROUP BY d.doc_id")
def paragraph_statistics(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array(S.paragraphs(F.col("text")))).alias("ps"))
    return rows.select("doc_id", F.size("ps").alias("paragraphs"), F.coalesce(F.array_max(F.transform("ps", F.length)), F.lit(0)).alias("longest"), F.sha2(F.array_join("ps", "\n"), 256).alias("paragraphs_sha256"))


@query("navigation_lines", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), x AS (SELECT doc_id, n, {sql.strip('raw')} AS x FROM l) SELECT doc_id, CAST(n AS INTEGER) AS n, {sql.navigation('x')} AS navigation FROM x")
def navigation_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    return lines.select("doc_id", "n", S.is_navigation(T.strip(F.col("raw"))).alias("navigation"))


@query("sentence_split", f"WITH s AS (SELECT doc_id, {_SENTENCES.format('text')} AS ss FROM documents) SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS n, unnest(ss) AS sentence FROM s")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


@query(
    "content_signals",
    rf"""WITH w AS (SELECT doc_id, text, regexp_extract_all({_ASCII.format("lower(text)")}, '\b[a-zA-Z]{{3,}}\b') AS ws FROM documents)
SELECT doc_id, len(ws) > 100 AS has_natural_language,
 len(list_filter(ws, lambda w: w IN ('function', 'class', 'method', 'variable', 'import', 'def', 'return', 'if', 'else', 'for', 'while', 'try', 'except', 'database', 'api', 'server', 'client', 'json', 'xml', 'html', 'css', 'javascript', 'python', 'java'))) > 5 AS has_technical_terms,
 regexp_matches(text, 'def\s+\w+\(.*\):|class\s+\w+:|import\s+\w+|print\(.*\)|console\.log\(.*\)|System\.out\.println\(.*\)|<[a-zA-Z][^>]*>') AS has_code_examples,
 regexp_matches(text, '\[\d+\]|\(\d{{4}}\)|et al\.|pp\.') AS has_references, len(regexp_extract_all(text, '(?m)^\s*(#+|\*+|\-+|\d+\.)\s+')) > 2 AS has_structure,
 round(coalesce(CAST(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS DOUBLE) / nullif(length(text), 0), 0), 6) AS content_density FROM w""",
)
def content_signals(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array(T.content_signals(F.col("text")))).alias("s"))
    return rows.select("doc_id", *[f"s.{c}" for c in ("has_natural_language", "has_technical_terms", "has_code_examples", "has_references", "has_structure")], F.round("s.content_density", 6).alias("content_density"))


_SIMILAR = r"(SELECT count(*) FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS w) x WHERE contains(lower(content), w))"


@query(
    "extraction_quality",
    rf"""WITH b AS (SELECT doc_id, text AS content, substring(string_split(text, chr(10))[1], 1, 120) AS title FROM documents),
m AS (SELECT doc_id, {words_sql('content')} AS words, len(list_filter(string_split_regex(content, '\n\s*\n'), lambda p: {words_sql('p')} >= 20)) AS paragraphs, title,
 list_distinct(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+')) AS tw, lower(content) AS low FROM b),
s AS (SELECT *, CASE WHEN low = '' OR len(tw) = 0 THEN 0.0 ELSE CAST(len(list_filter(tw, lambda w: contains(low, w))) AS DOUBLE) / len(tw) END AS sim,
 low <> '' AND regexp_matches(low, '{"|".join(x.replace(".", chr(92) + ".") for x in Q.BLOCKED)}') AS blocked, regexp_matches(low, '{"|".join(Q.PAYWALL)}') AS wall FROM m),
q AS (SELECT *, CASE WHEN blocked OR wall THEN 0.0 ELSE least(0.25 * sim
 + CASE WHEN words >= 800 THEN 0.20 WHEN words >= 150 THEN 0.20 * words / 800 ELSE 0.08 * words / 150 END
 + CASE WHEN paragraphs >= 4 THEN 0.20 WHEN paragraphs >= 2 THEN 0.20 * paragraphs / 4 ELSE 0.08 * paragraphs / 2 END
 + 0.15 * 0.5 + CASE WHEN words > 50 THEN 0.07 ELSE 0.05 END + CASE WHEN length(trim(title)) > 0 THEN 0.10 ELSE 0 END, 1.0) END AS score FROM s)
SELECT doc_id, CAST(words AS INTEGER) AS words, CAST(paragraphs AS INTEGER) AS paragraphs, round(CAST(sim AS DOUBLE), 6) AS title_similarity, round(CAST(score AS DOUBLE), 6) AS score,
 CASE WHEN blocked THEN 'blocked_page_detected' WHEN wall THEN 'paywall_detected' WHEN words < 150 THEN 'insufficient_words' WHEN sim < 0.30 THEN 'poor_title_match'
 WHEN paragraphs < 2 THEN 'insufficient_paragraphs' WHEN score < 0.50 THEN 'low_quality_score' ELSE 'acceptable' END AS reason FROM q""",
)
def extraction_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.substring(F.split("text", "\n")[0], 1, 120).alias("title"))
    rows = docs.select("doc_id", F.explode(F.array(Q.assess(F.col("text"), F.col("title")))).alias("a"))
    return rows.select("doc_id", "a.words", "a.paragraphs", F.round("a.title_similarity", 6).alias("title_similarity"), F.round("a.score", 6).alias("score"), "a.reason")


@query(
    "extraction_confidence",
    rf"""WITH m AS (SELECT doc_id, text, {words_sql('text')} AS w, (['trafilatura', 'justext', 'heuristic-readability', 'other'])[doc_id % 4 + 1] AS method FROM documents)
SELECT doc_id, method, round(CAST(least(CASE WHEN w > 300 AND w < 8000 THEN 0.3 WHEN w > 8000 THEN 0.2 ELSE 0 END
 + CASE method WHEN 'trafilatura' THEN 0.95 WHEN 'justext' THEN 0.85 WHEN 'heuristic-readability' THEN 0.75 ELSE 0.5 END
 + CASE WHEN len(regexp_extract_all(text, 'https?://')) < w * 0.02 THEN 0.1 ELSE 0 END
 + CASE WHEN length(text) - length(replace(text, '.', '')) > w * 0.03 THEN 0.1 ELSE 0 END
 + CASE WHEN len(regexp_extract_all(text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{1,3}}\b')) > 5 THEN 0.1 ELSE 0 END, 1.0) AS DOUBLE), 6) AS confidence FROM m""",
)
def extraction_confidence(spark, d):
    method = F.element_at(F.array(*[F.lit(x) for x in ("trafilatura", "justext", "heuristic-readability", "other")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", "text", method.alias("method"))
    return rows.select("doc_id", "method", F.round(Q.confidence(F.col("text"), F.col("method")), 6).alias("confidence"))


@query("document_sections", f"WITH {sql.SECTIONS} SELECT doc_id, section, CAST(len(lines) AS INTEGER) AS n_lines, sha256(array_to_string(lines, chr(10))) AS lines_sha256 FROM sections")
def document_sections(spark, d):
    return D.sections(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "section", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha256"))


_URL_TYPE = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(url), '{marks}') THEN '{name}'"
    for name, marks in (
        ("encyclopedia", r"wikipedia\.org|wiki\."), ("official_docs", r"docs\.python\.org|documentation"), ("tutorial", "tutorial|course|learn"), ("blog", r"blog|medium\.com|dev\.to"),
        ("qna", r"stackoverflow\.com|stackexchange\.com"), ("code_repository", r"github\.com|gitlab\.com"), ("research_paper", r"research|arxiv\.org|academic"), ("news_article", "news|article|press"),
    )
) + " ELSE 'unknown' END"


@query(
    "structured_documents",
    f"""WITH {CAND}, {_CLEAN.replace('{0}', '(SELECT pos AS doc_id, content AS text FROM cand)')} SELECT pos, {_URL_TYPE} AS content_type, CAST({words_sql('t')} AS INTEGER) AS word_count, CAST(len({_SENTENCES.format('t')}) AS INTEGER) AS sentences_count,
 sha256(t) AS cleaned_sha256 FROM cand JOIN cleaned ON doc_id = pos""",
)
def structured_documents(spark, d):
    return D.structured(candidates(spark, d), "pos", "content", "url").select("pos", "content_type", "word_count", "sentences_count", F.sha2("cleaned_content", 256).alias("cleaned_sha256"))


@query("structured_quality")
def structured_quality(spark, d):
    return D.structured(candidates(spark, d), "pos", "content", "url").select("pos", "paragraph_count", F.size("content_sections").alias("sections"), F.sha2("first_paragraph", 256).alias("first_sha256"), "content_quality_score")


@query(
    "deduplicated_sentences",
    r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents),
e AS (SELECT doc_id, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g')) ORDER BY i) AS turn FROM e),
j AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM k WHERE turn = 1 GROUP BY doc_id) SELECT doc_id, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN j USING (doc_id)""",
)
def deduplicated_sentences(spark, d):
    from ..operators.dedup import dedupe_sentences

    return table(spark, d, "documents").select("doc_id", F.sha2(dedupe_sentences(F.col("text")), 256).alias("kept_sha256"))


@query(
    "query_types",
    "SELECT doc_id, CASE greatest("
    + ", ".join(" + ".join(f"CAST(regexp_matches(q, '{p}') AS INTEGER)" for p in ps) for _, ps in Q.QUERY_TYPES)
    + ") WHEN 0 THEN 'web' "
    + " ".join(f"WHEN {' + '.join(f'CAST(regexp_matches(q, {chr(39)}{p}{chr(39)}) AS INTEGER)' for p in ps)} THEN '{n}'" for n, ps in Q.QUERY_TYPES)
    + " END AS query_type FROM (SELECT doc_id, lower((['latest news update', 'python api error', 'neural model paper', 'weather map city', 'what is data', 'music video', 'nothing'])[doc_id % 7 + 1]) AS q FROM documents)",
)
def query_types(spark, d):
    q = F.element_at(F.array(*[F.lit(x) for x in ("latest news update", "python api error", "neural model paper", "weather map city", "what is data", "music video", "nothing")]), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", Q.classify_query(q).alias("query_type"))


@query(
    "converted_counts",
    r"""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN (o_orderkey % 100) || '.5K' WHEN 2 THEN (o_orderkey % 9) || 'M' WHEN 3 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') ELSE 'n/a' END AS t FROM orders),
x AS (SELECT o_orderkey, regexp_replace(trim(t), '[ ,]', '', 'g') AS t FROM v)
SELECT o_orderkey, CAST(floor(TRY_CAST(regexp_extract(t, '^([0-9]*\.?[0-9]+)([KkMm]?)$', 1) AS DOUBLE) * CASE upper(regexp_extract(t, '^([0-9]*\.?[0-9]+)([KkMm]?)$', 2)) WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 ELSE 1 END + 1e-9) AS BIGINT) AS n FROM x""",
)
def converted_counts(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.concat((k % 100).cast("string"), F.lit(".5K"))).when(k % 5 == 2, F.concat((k % 9).cast("string"), F.lit("M"))).when(k % 5 == 3, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise("n/a")
    return table(spark, d, "orders").select("o_orderkey", D.convert_count(text).alias("n"))


@query(
    "retry_classes",
    """WITH s AS (SELECT event_id, (ARRAY[200, 404, 429, 500, 503, 301, 418, 599, 204, 451])[event_id % 10 + 1] AS status FROM events)
SELECT event_id, CAST(status AS INTEGER) AS status, CASE WHEN status IN (408, 425, 429, 500, 502, 503, 504) THEN 'transient' WHEN status IN (400, 401, 403, 404, 405, 406, 410, 451) THEN 'permanent'
 WHEN status BETWEEN 200 AND 299 THEN 'success' WHEN status BETWEEN 400 AND 499 THEN 'permanent' WHEN status BETWEEN 500 AND 599 THEN 'transient' ELSE 'unknown' END AS class,
 round(CAST(least(CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 100 AS DOUBLE) ELSE 1.5 * (event_id % 7 + 1) END, 60.0) AS DOUBLE), 6) AS wait_seconds FROM s""",
)
def retry_classes(spark, d):
    e = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 429, 500, 503, 301, 418, 599, 204, 451)]), (e % 10 + 1).cast("int"))
    told = F.when(e % 3 == 0, (e % 100).cast("string"))
    wait = Q.wait_seconds(told, F.lit(None).cast("string"), e % 7, F.lit(0.0))
    return table(spark, d, "events").select("event_id", status.alias("status"), Q.classify_status(status).alias("class"), F.round(wait, 6).alias("wait_seconds"))
