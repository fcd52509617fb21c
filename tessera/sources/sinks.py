"""Sinks: JSON, JSON lines, CSV, text, Markdown, chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that CSV exports put first.
CSV_FIRST = ("title", "url", "published", "domain", "author", "summary")
LINE = 500


def _nested_as_json(rows: DataFrame) -> DataFrame:
    nested = (T.StructType, T.ArrayType, T.MapType)
    return rows.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in rows.schema.fields])


def csv_columns(rows: DataFrame) -> DataFrame:
    """Priority columns, then the rest by name; nested values as JSON."""
    first = [c for c in CSV_FIRST if c in rows.columns]
    return _nested_as_json(rows.select(*first, *sorted(c for c in rows.columns if c not in first)))


def write_csv(rows: DataFrame, path: str) -> None:
    csv_columns(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, max_line: int = LINE, skip: tuple[str, ...] = ("url", "href", "link")) -> None:
    """JSON lines; strings over ``max_line`` characters become arrays of lines."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = [wrap_lines(F.col(c), max_line).alias(c) if isinstance(kinds[c], T.StringType) and c not in skip else F.col(c) for c in rows.columns]
    rows.select(*out).write.mode("overwrite").json(path)


def wrap_lines(text: Column, limit: int = LINE) -> Column:
    """Lines of at most ``limit`` characters, cut at white space where there is some, with nothing lost but that white space."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{limit}}}(?=\s|$)|\S{{{limit}}})\s*"), F.lit(1))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")


def write_pages(rows: DataFrame, path: str, text: str = "main_content") -> None:
    """Text files of good extractions: success, confidence over 0.75, more than 300 words."""
    good = rows.where((F.col("extraction_status") == "success") & (F.col("confidence_score") > 0.75) & (F.col("content_word_count") > 300))
    good.select(F.col(text).alias("value"), safe_name(F.col("title")).alias("name")).write.mode("overwrite").partitionBy("name").text(path)


def safe_name(title: Column, most: int = 50) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"[^\w\s-]", ""), r"[\s]+", "_"), 1, most)


def append_chunks(index: DataFrame, path: str) -> None:
    index.write.mode("append").parquet(path)


def _cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def titled(name: str) -> str:
    return name.replace("_", " ").title()


def markdown_rows(rows: DataFrame, columns: int = 8) -> DataFrame:
    """(line): each row as a row of a Markdown table of the first ``columns`` columns, in the order of ``rows``."""
    names = _nested_as_json(rows.select(*rows.columns[:columns])).columns
    cells = [_cell(F.col(f"`{n}`")) for n in names]
    return _nested_as_json(rows.select(*names)).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(rows: DataFrame, title: str, columns: int = 8) -> list[str]:
    names = rows.columns[:columns]
    return [f"# {title}", "", "| " + " | ".join(map(titled, names)) + " |", "|" + " --- |" * len(names)]


def write_markdown(rows: DataFrame, path: str, title: str, columns: int = 8) -> None:
    """All of ``rows`` as text files that read as one table in the order of their names; the head is a file of its own."""
    spark = rows.sparkSession
    spark.createDataFrame([("\n".join(markdown_head(rows, title, columns)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0-head")
    markdown_rows(rows, columns).withColumnRenamed("line", "value").write.mode("overwrite").text(f"{path}/1-rows")


def markdown(rows: DataFrame, title: str, columns: int = 8) -> str:
    """The same as one string, for results of a page or two: a row at a time reaches the driver, and all of them stay there."""
    lines = markdown_head(rows, title, columns) + [r["line"] for r in markdown_rows(rows, columns).toLocalIterator()]
    return "\n".join(lines) + "\n"


def markdown_value(value, key: str = "", level: int = 1) -> list[str]:
    """Lines of a nested value: maps as headings, lists of records as tables of their first eight fields, other lists as items."""
    if isinstance(value, dict):
        lines = [f"{'#' * min(level, 6)} {titled(key)}", ""] if key else []
        for k, v in value.items():
            nested = isinstance(v, (dict, list))
            lines += markdown_value(v, k, level + 1) if nested else [f"- **{titled(k)}:** {'' if v is None else v}"]
        return lines + [""]
    if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
        names = list(dict.fromkeys(k for x in value for k in x))[:8]
        cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
        table = ["| " + " | ".join(map(titled, names)) + " |", "|" + " --- |" * len(names)] + ["| " + " | ".join(cell(x.get(n)) for n in names) + " |" for x in value]
        return [f"{'#' * min(level, 6)} {titled(key)}", "", *table, ""]
    return [f"{'#' * min(level, 6)} {titled(key)}", "", *[f"- {x}" for x in value], ""]


def yaml_rows(rows: DataFrame) -> DataFrame:
    """(line): each row as an item of a YAML list, with its values as JSON, which YAML reads."""
    value = lambda n: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(f"`{n}`").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))
    fields = [F.concat(F.lit(("- " if k == 0 else "  ") + n + ": "), F.coalesce(F.nullif(value(n), F.lit("")), F.lit("null"))) for k, n in enumerate(rows.columns)]
    return rows.select(F.concat_ws("\n", *fields).alias("line"))


def write_yaml(rows: DataFrame, path: str) -> None:
    yaml_rows(rows).withColumnRenamed("line", "value").write.mode("overwrite").text(path)


def yaml(rows: DataFrame) -> str:
    """The same as one string, for results of a page or two."""
    lines = [r["line"] for r in yaml_rows(rows).toLocalIterator()]
    return "\n".join(lines) + "\n" if lines else "[]\n"
