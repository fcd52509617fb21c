"""Adapters from landed tables to candidate records, and the unified record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The content-type vocabulary of unified records; anything else becomes 'academic'.
CONTENT_TYPES = ("academic", "dataset", "book", "media", "event", "geo", "knowledge", "podcast", "code")


def filled(*columns: str | Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def candidates_from_documents(docs: DataFrame, hosts: tuple[str, ...], sources: tuple[str, ...], newest: str) -> DataFrame:
    """Candidate records of a text table.

    The title is the head of the first line; host, source name, type and date
    follow from doc_id, so that rankings have all their signals.  As in the
    queries' SQL a remainder has the sign of doc_id: places below 0 count from the
    end, place 0 is null, and dates are later than ``newest``.
    """
    place = lambda n: (F.col("doc_id") % n + 1).cast("int")
    pick = lambda xs: F.when(place(len(xs)) != 0, F.element_at(F.array(*[F.lit(x) for x in xs]), place(len(xs))))
    at = F.to_timestamp(F.lit(newest)) - F.make_interval(hours=(F.col("doc_id") * 7 % 3000).cast("int"))
    return docs.select(
        F.col("doc_id").alias("pos"),
        F.substring(F.split("text", "\n")[0], 1, 120).alias("title"),
        F.substring("text", 1, 200).alias("snippet"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://"), pick(hosts), F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        pick(sources).alias("source"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publish_date"),
        pick((*CONTENT_TYPES, "news", "web")).alias("content_type"),
        "lang",
    )


def unified(rows: DataFrame, default_source: str = "web") -> DataFrame:
    """Records with the fields of search results, whatever synonyms the rows use.

    Missing synonyms are skipped, numbers are coerced, a score out of 100 becomes
    the authority, and all other columns go to ``metadata`` as JSON.
    """
    have = {c.lower(): c for c in rows.columns}
    pick = lambda *names: filled(*[have[n] for n in names if n in have]) if any(n in have for n in names) else F.lit(None).cast("string")
    used = {"id", "title", "url", "href", "link", "snippet", "body", "summary", "description", "content", "cleaned_content", "source", "engine", "content_type", "timestamp", "publish_date", "date", "authority_score", "score", "relevance_score", "lang", "language", "pos"}
    number = lambda name: F.coalesce(have[name] and F.col(have[name]).try_cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)
    rest = [c for c in rows.columns if c.lower() not in used]
    kind = F.lower(F.coalesce(pick("content_type"), F.lit("web")))
    authority = F.greatest(number("authority_score"), F.least(number("score") / 100, F.lit(1.0)))
    return rows.select(
        *([F.col(have["pos"]).alias("pos")] if "pos" in have else []),
        F.coalesce(pick("id", "url", "href", "link"), F.lit("")).alias("id"),
        F.coalesce(pick("source", "engine"), F.lit(default_source)).alias("source"),
        F.coalesce(pick("url", "href", "link"), F.lit("")).alias("url"),
        F.coalesce(pick("title"), F.lit("")).alias("title"),
        F.coalesce(pick("snippet", "body", "summary", "description"), F.lit("")).alias("snippet"),
        F.coalesce(pick("content", "cleaned_content"), F.lit("")).alias("content"),
        F.when(kind.isin(*CONTENT_TYPES, "news", "web"), kind).otherwise("academic").alias("content_type"),
        F.coalesce(pick("timestamp", "publish_date", "date"), F.lit("")).alias("timestamp"),
        authority.alias("authority_score"),
        number("relevance_score").alias("relevance_score"),
        F.coalesce(pick("lang", "language"), F.lit("")).alias("lang"),
        (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("metadata"),
    )


def prune_empty(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """JSON ``column`` without null and empty members (top level)."""
    entries = F.map_filter(F.from_json(column, "map<string,string>"), lambda k, v: v.isNotNull() & ~v.isin("", "[]", "{}", "null"))
    return rows.withColumn(column, F.to_json(entries))


def flatten(rows: DataFrame, list_limit: int = 50) -> DataFrame:
    """Nested structs as dotted columns; arrays joined with '; ' up to ``list_limit`` members."""
    from pyspark.sql import types as T

    def walk(kind: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for field in kind.fields:
            at = (*path, field.name)
            column = F.col(".".join(f"`{p}`" for p in at))
            if isinstance(field.dataType, T.StructType):
                out += walk(field.dataType, at)
            elif isinstance(field.dataType, T.ArrayType):
                flat = F.transform(F.slice(column, 1, list_limit), lambda x, f=field: F.to_json(x) if isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)) else x.cast("string"))
                out.append(F.array_join(flat, "; ").alias(".".join(at)))
            else:
                out.append(column.alias(".".join(at)))
        return out

    return rows.select(*walk(rows.schema, ()))


def abstract_text(inverted: str | Column) -> Column:
    """Text of an inverted index {word: [positions]}."""
    c = F.col(inverted) if isinstance(inverted, str) else inverted
    places = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda s: s["w"]), " ")
