"""Queries over ids below 0 against their SQL in DuckDB, where a remainder has the sign of the id."""

from __future__ import annotations

import pytest

from .test_non_ascii import test_query_equals_its_sql as equals_its_sql


@pytest.mark.parametrize("name", ["initial_ranking", "legacy_ranking", "bm25f_scores"])
def test_ids_below_zero(spark, tmp_path, name):
    rows = [(i, f"from the only {i % 4} with", "de", "src", 10) for i in range(-90, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    equals_its_sql(spark, str(tmp_path), name)
