"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, language, licenses, lines, packing, quality, secrets, simhash, suffix_array, suffix_tree
from .common import read


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": _over_documents(language.language_digest),
    "op2_suffix_array_dedup": _over_documents(suffix_array.suffix_array_digest),
    "op3_best_fit_packing": _over_documents(packing.pack),
    "op4_decontamination": lambda spark, sf_dir: decontam.decontamination_digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
    "op5_license_scans": _over_documents(licenses.licenses_digest),
    "op6_line_dedup": _over_documents(lines.lines_digest),
    "op7_secret_scans": _over_documents(secrets.secrets_digest),
    "op8_simhash_dedup": _over_documents(simhash.simhash_digest),
    "op9_substring_dedup": _over_documents(suffix_tree.suffix_tree_digest),
    "op10_quality_rules": _over_documents(quality.quality_digest),
}

ORACLES: dict[str, str] = {
    "op5_license_scans": licenses.oracle(),
    "op6_line_dedup": lines.oracle(),
    "op7_secret_scans": secrets.oracle(),
    "op9_substring_dedup": suffix_tree.oracle(),
    "op10_quality_rules": quality.oracle(),
}
