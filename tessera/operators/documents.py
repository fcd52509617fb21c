"""Documents: structured cleaning output, sections, keywords, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import structure as S
from ..functions import text as T
from . import quality


def keywords(docs: DataFrame, key: str, text: str, n: int = 15, least: int = 4) -> DataFrame:
    """(key, keyword, count, place): the most frequent words of each text; ties by first appearance."""
    words = docs.select(key, F.posexplode(T.keyword_tokens(F.col(text), least)).alias("at", "keyword"))
    counts = words.groupBy(key, "keyword").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "at"))
    return counts.withColumn("place", place).where(F.col("place") <= n).drop("at")


MAIN = "Main Content"


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, lines): a text's lines below their headings, without navigation.

    Headings are marked with #, set in capitals, or look like one (``structure.heading``);
    the same title again goes on with its section.  Lines before the first heading and
    those of sections that are no content are the section ``MAIN``.
    """
    raw = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "raw")).withColumn("line", T.strip(F.col("raw")))
    order = Window.partitionBy(key).orderBy("n")
    seen = raw.withColumn("ahead", F.collect_list("line").over(order.rowsBetween(1, 5))).withColumn("copies", F.count_if(F.col("raw") == F.col("line")).over(Window.partitionBy(key, "line"))).where(F.col("line") != "")
    line = F.col("line")
    mark = F.regexp_extract(line, T.FLAGS + r"^#{1,6}\s+(.*)$", 1)
    title = (
        F.when(line.rlike(T.FLAGS + r"^#{1,6}\s+.*$"), F.regexp_replace(T.strip(mark), "[#*_`]", ""))
        .when(line.rlike(T.FLAGS + r"^[A-Z\s]{5,30}$"), line)
        .otherwise(S.heading(line, F.col("ahead"), F.col("copies")))
    )
    marked = seen.withColumn("title", title)
    current = F.last(F.nullif("title", F.lit("")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    filled = marked.withColumn("section", F.coalesce(current, F.lit(MAIN)))
    place = F.when(F.col("section") == MAIN, -1).otherwise(F.min("n").over(Window.partitionBy(key, "section")))
    body = filled.withColumn("place", place).where(F.col("title").isNull() & (F.length("line") > 10) & ~S.is_navigation(line))
    parts = body.groupBy(key, "section", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    own = F.when(S.is_content(F.col("lines")), F.col("section")).otherwise(F.lit(MAIN)).alias("section")
    return parts.select(key, own, "place", "lines").groupBy(key, "section").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "lines"))), lambda x: x["lines"])).alias("lines"))


# What a URL tells about the type of its content, in order of precedence.
CONTENT_TYPES = (
    ("encyclopedia", ("wikipedia.org", "wiki.")), ("official_docs", ("docs.python.org", "documentation")), ("tutorial", ("tutorial", "course", "learn")),
    ("blog", ("blog", "medium.com", "dev.to")), ("qna", ("stackoverflow.com", "stackexchange.com")), ("code_repository", ("github.com", "gitlab.com")),
    ("research_paper", ("research", "arxiv.org", "academic")), ("news_article", ("news", "article", "press")),
)


def url_content_type(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    out = F
    for name, marks in CONTENT_TYPES:
        out = out.when(low.rlike("|".join(m.replace(".", r"\.") for m in marks)), name)
    return out.otherwise("unknown")


def structured(docs: DataFrame, key: str, text: str, url: str, confidence: str | None = None, normalize: bool = True) -> DataFrame:
    """Structured documents: cleaned text, counts, paragraphs, sections, sample sentences, readability, signals, type and quality."""
    conf = F.coalesce(F.col(confidence), F.lit(0.0)) if confidence else F.lit(0.5)
    cleaned = docs.select(key, url_content_type(F.col(url)).alias("content_type"), conf.alias("confidence"), F.explode(F.array(T.clean(F.col(text), normalize))).alias("cleaned_content"))
    c = F.col("cleaned_content")
    parts = cleaned.select("*", F.explode(F.array(F.struct(S.paragraphs(c).alias("paragraphs"), T.content_signals(c).alias("signals"), T.readability(c).alias("readability"), T.sentences(c).alias("sentences")))).alias("s"))
    listed = sections(cleaned, key, "cleaned_content").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("section", "lines"))).alias("content_sections"))
    joined = parts.join(listed, key, "left").withColumn("content_sections", F.coalesce("content_sections", F.create_map().cast("map<string,array<string>>")))
    words = T.word_count(c)
    score = quality.document_quality(F.col("confidence"), words, F.size("content_sections"), F.size("s.paragraphs"), F.col("s.signals.has_natural_language"))
    return joined.select(
        key, "cleaned_content", words.alias("word_count"), F.size("s.paragraphs").alias("paragraph_count"), S.opening_paragraph(F.col("s.paragraphs"), c).alias("first_paragraph"),
        "content_sections", F.size("s.sentences").alias("sentences_count"), F.slice("s.sentences", 1, 5).alias("sample_sentences"), "s.readability", "s.signals", "content_type",
        F.when(c == "", 0.0).otherwise(F.round(score, 2)).alias("content_quality_score"),
    )


def process(rows: DataFrame, status: str = "extraction_status", score: str = "content_quality_score", pos: str = "position") -> DataFrame:
    """Successful rows, best first."""
    return rows.where(F.col(status) == "success").orderBy(F.desc(score), F.asc(pos))


def truncate(text: Column, max_chars: int | None = None, max_bytes: int | None = None) -> Column:
    """At most so many characters, or bytes of UTF-8 (a cut character is dropped)."""
    if max_chars is not None:
        return F.substring(text, 1, max_chars)
    if max_bytes is not None:
        head = F.substring(F.encode(text, "UTF-8"), 1, max_bytes)
        return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.regexp_replace(F.make_valid_utf8(head.cast("string")), "\ufffd+$", ""))
    return text


def fallback_content(main: Column, meta: Column, snippet: Column, rendered: Column) -> Column:
    """Struct (content, confidence, method): extraction, else rendered text, snippet, meta description."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    pick = lambda c, v, m: F.struct(c.alias("content"), F.lit(v).alias("confidence"), F.lit(m).alias("method"))
    return (
        F.when(has(main), pick(main, 1.0, "extracted")).when(has(rendered), pick(rendered, 0.6, "rendered"))
        .when(has(snippet), pick(snippet, 0.5, "snippet")).otherwise(pick(F.coalesce(meta, F.lit("")), 0.4, "meta"))
    )


def convert_count(value: Column) -> Column:
    """'1.2K' -> 1200, '3M' -> 3000000, '5,432' -> 5432; Cyrillic letters count as Latin ones; else null."""
    v = F.regexp_replace(F.trim(value), "[ ,]", "")
    number = F.regexp_extract(v, r"^([0-9]*\.?[0-9]+)([KkMmКкМм]?)$", 1).try_cast("double")
    unit = F.regexp_extract(v, r"^([0-9]*\.?[0-9]+)([KkMmКкМм]?)$", 2)
    return F.floor(number * F.when(unit.rlike("[KkКк]"), 1000).when(unit.rlike("[MmМм]"), 1_000_000).otherwise(1) + 1e-9).cast("long")


def parse_size(text: Column) -> Column:
    """'5mb' -> bytes, with one of the units b, kb, mb and gb; else null."""
    pattern = r"^([0-9.]+)\s*(b|kb|mb|gb)$"
    t = F.lower(F.trim(text))
    number, unit = F.regexp_extract(t, pattern, 1).try_cast("double"), F.regexp_extract(t, pattern, 2)
    return F.floor(number * F.when(unit == "b", 1).when(unit == "kb", 1024).when(unit == "mb", 1024**2).when(unit == "gb", 1024**3)).cast("long")
