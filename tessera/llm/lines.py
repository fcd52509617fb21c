"""Line de-duplication by site-relative frequency.

For each host, the pages that contain a line are divided by the pages of the
host; a line above ``ratio`` on at least ``least_pages`` pages is boilerplate and
is dropped from that host's pages.  Pages with one and the same text count as one
page, so copies of an article do not make its lines boilerplate.

Counts are partial aggregates over (host, line hash, text hash), and what is
joined back is one short list for each host: lines above a ratio number at most
the mean lines of a page divided by the ratio.  The lists are written first: they
are broadcast only if they were counted to be small, else the pages are joined by
host and, the other side being a table, adaptive execution can split a hot host.

Defined cases: a line is compared without the white space at its ends; lines
without a word are neither counted nor dropped; null text stays null and counts
as no page; a null host is a host of its own; repeated rows are one page; an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_REGEX, free_name, let, stored, text_or_empty

RATIO = 0.01
LEAST_PAGES = 10
#: Boilerplate lines (8 bytes each) of all hosts that may be broadcast.
BROADCAST_LINES = 500_000
ENDS = " \t\r\x0b\f"


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(ENDS)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line): hashes of the lines to drop, with the pages that contain them."""
    pages = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(text).alias("page"), F.col(text).alias("text"))
    totals = pages.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("n_host"))
    hashed = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: x.rlike(WORD_REGEX)), _line_hash))
    counts = (
        pages.select("host", "page", F.explode(hashed).alias("line"))
        .groupBy("host", "line", "page").agg(F.lit(1).alias("one"))
        .groupBy("host", "line").agg(F.count("one").alias("n_pages"))
        .where(F.col("n_pages") >= least_pages)
    )
    return counts.join(totals, "host").where(F.col("n_pages") > ratio * F.col("n_host")).select("host", "line", "n_pages", "n_host")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, dropped: str | None = None) -> DataFrame:
    """``docs`` with ``text`` without its host's boilerplate lines; ``dropped`` names a column for their number."""
    per_host = stored(boilerplate(docs, host, text, ratio, least_pages).groupBy("host").agg(F.collect_set("line").alias("lines")))
    if (per_host.agg(F.sum(F.size("lines"))).first()[0] or 0) <= BROADCAST_LINES:
        per_host = F.broadcast(per_host)
    key, lines, left = (free_name(docs, f"boilerplate_{c}") for c in ("host", "lines", "left"))
    joined = docs.withColumn(key, F.coalesce(F.col(host), F.lit(""))).join(per_host.select(F.col("host").alias(key), F.col("lines").alias(lines)), key, "left")
    # the host's list is met once by hashing; what is left of it is the page's own
    own = let(F.array_intersect(F.transform(_lines(F.col(text)), _line_hash), F.col(lines)), lambda gone: F.filter(_lines(F.col(text)), lambda x: ~(F.array_contains(gone, _line_hash(x)) & x.rlike(WORD_REGEX))))
    kept = F.when(F.col(lines).isNull() | F.col(text).isNull(), F.lit(None)).otherwise(own)
    # explode of one element keeps the optimizer from computing it at each use
    joined = joined.select("*", F.explode(F.array(kept)).alias(left))
    changed = F.when(F.col(left).isNull(), F.col(text)).otherwise(F.array_join(F.col(left), "\n"))
    number = F.when(F.col(left).isNull(), F.lit(0)).otherwise(F.size(_lines(F.col(text))) - F.size(F.col(left))).cast("long")
    out = [changed.alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*out, *([number.alias(dropped)] if dropped else []))


def lines_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each document; a null text counts as empty."""
    rows = docs.select("doc_id", "source", "text", F.size(_lines(text_or_empty())).cast("long").alias("n_lines"))
    return drop_boilerplate(rows, dropped="n_dropped").select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty(), 256).alias("kept_sha256"))


def oracle(ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    """The digest in DuckDB SQL."""
    trim = "trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
    word = r"regexp_matches(line, '[^\x20\x09-\x0D]')"
    return f"""
WITH pages AS (SELECT DISTINCT coalesce(source, '') AS host, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT host, count(*) AS n_host FROM pages GROUP BY host),
page_lines AS (SELECT host, text, unnest(string_split(text, chr(10))) AS line FROM pages),
counts AS (SELECT host, {trim} AS line, count(DISTINCT text) AS n_pages FROM page_lines WHERE {word} GROUP BY 1, 2),
boiler AS (SELECT host, line FROM counts JOIN totals USING (host) WHERE n_pages >= {least_pages} AND n_pages > {ratio} * n_host),
split AS (SELECT doc_id, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
rows AS (SELECT doc_id, host, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
marked AS (SELECT doc_id, line, i, ({word} AND EXISTS (SELECT 1 FROM boiler b WHERE b.host = r.host AND b.line = {trim.replace('line', 'r.line')})) AS gone FROM rows r)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
