"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Stages are written and read again between
one another, so a lost executor never costs more than the stage it ran in.

Defined cases, for every stage: null and empty texts and texts without a word fail
the quality policy and go with the first stage; a later one that met them would find
no line and no benchmark item in them, take them for equal texts and pack each as
one piece of the closing id.  Repeated rows stand or fall together, but for the pieces of the
last stage, of which each row has its own.  Of equal texts the smallest doc_id
stays, and so do rows without an id.  A very long text is worked on whole.  An
empty table gives an empty table, an empty benchmark drops nothing.  Further
columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, lines, packing, quality, simhash
from tessera.llm.common import cut, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate on their source go; ``n_chars`` follows the text."""
    kept = lines.drop_boilerplate(docs)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with 80 % of their five-word shingles in common, one stays: by SimHash and pivot distance tables, and by bands of minima for what lies farther apart."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly one, go."""
    return decontam.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", packing_stage),
]

#: Edit distances, fingerprints and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
