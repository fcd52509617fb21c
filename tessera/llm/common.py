"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, new_folder, stored

__all__ = ["ARROW_ROWS", "WORD_REGEX", "bound_arrow", "bucketed", "cut", "free_name", "let", "new_folder", "read", "stored", "text_or_empty"]

#: The ASCII white space that separates words in every contract of this package.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch; texts may be long, so batches stay small.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts fits a small worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """``df`` as a table in the shared folder, dealt by ``column`` as an exchange would, so that joins on it need none."""
    spark = df.sparkSession
    folder = new_folder(spark)
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.option("path", folder).bucketBy(parts, column).saveAsTable(name)
    return spark.table(name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
