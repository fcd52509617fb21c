"""What the registered queries share: tables, parameters, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem_sql
from ..operators.ingest import CONTENT_TYPES, candidates_from_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOSTS = ("arxiv.org", "www.bbc.com", "github.com", "example.org", "en.wikipedia.org", "m.example.net", "nasa.gov")
SOURCES = ("TechCrunch:AI", "google-news", "duckduckgo", "unknown-wire", "toi", "rss:www.nasa.gov")
NEWEST = "2024-03-01 00:00:00"
NOW_TEXT = "2024-03-02 00:00:00"
QUERY = "from the only with"
OPERATORS = '+from -onth "of the"'


def now():
    return F.to_timestamp(F.lit(NOW_TEXT))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_from_documents(table(spark, sf_dir, "documents"), HOSTS, SOURCES, NEWEST)


def query(name: str, oracle: str | None = None):
    """Register ``name``; ``oracle`` is the same result in DuckDB SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return f

    return add


# ------------------------------------------------------------- SQL fragments
def _pick(values: tuple[str, ...]) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[doc_id % {len(values)} + 1]"


CAND = f"""cand AS (
  SELECT doc_id AS pos, substring(string_split(text, chr(10))[1], 1, 120) AS title, substring(text, 1, 200) AS snippet, text AS content,
         'https://' || {_pick(HOSTS)} || '/' || source || '/' || doc_id AS url, {_pick(SOURCES)} AS source,
         strftime(TIMESTAMP '{NEWEST}' - to_hours(CAST((doc_id * 7) % 3000 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS publish_date,
         {_pick((*CONTENT_TYPES, 'news', 'web'))} AS content_type, lang
  FROM documents)"""
#: Age in hours of a candidate at NOW.
AGE = f"(epoch(TIMESTAMP '{NOW_TEXT}') - epoch(strptime(publish_date, '%Y-%m-%dT%H:%M:%SZ'))) / 3600.0"


def tokens_sql(text: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+')"


def duck_stem(word: str) -> str:
    return stem_sql(word, f"length({word}) = strlen({word})")


def count_sql(text: str, term: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, '{term}', ''))) / {len(term)} AS INTEGER)"


def words_sql(text: str) -> str:
    return rf"len(regexp_extract_all(coalesce({text}, ''), '\S+'))"


def host_sql(url: str) -> str:
    return rf"regexp_replace(lower(CASE WHEN regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) <> '' THEN regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) ELSE string_split({url}, '/')[1] END), '^www\.', '')"
