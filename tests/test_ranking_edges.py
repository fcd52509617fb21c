"""Ranking queries against their SQL in DuckDB over rows that the tables at hand do not have."""

from __future__ import annotations

import duckdb
import pytest

from tessera.plans.catalog import ORACLES, QUERIES


def assert_equal(spark, folder, name, texts):
    rows = [(i, t, "de", "src", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*names).collect())) == sorted(found.fetchall())


def test_composite_scores_keep_null_texts(spark, tmp_path):
    assert_equal(spark, tmp_path, "composite_scores", {0: "from the only with", 1: None, 2: None, 3: "only", 4: ""})


def test_composite_scores_halfway_between_two_roundings(spark, tmp_path):
    assert_equal(spark, tmp_path, "composite_scores", {0: "from the only with", 3: "y", 4: "y", 6: "y", 76888: "x", 186888: "x", 119728: "z", 229728: "z"})
