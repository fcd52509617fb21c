"""Queries over words beyond ASCII against their SQL in DuckDB, where bytes are not characters."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25f
from tessera.plans.catalog import ORACLES, QUERIES

TEXTS = [
    "ühe einung with", "ßhe einung from", "thé einung", "tühe einung", "the einung", "te einung thün", "öf einung only", "einung", "thin of the thin", "onlü from",
    "Ach Bchüber " * 6, "üAch Bch " * 6, "Ach Bch " * 6, "Ach\x0bBch. " * 6, "Ach Bche\u0301 " * 6, "word\x0b" * 400, "Ach Bch_ " * 6,
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("non_ascii")
    rows = [(i, t, "de", f"src{i % 3}", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{out}/documents.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["bm25f_phrase_fuzzy", "bm25f_scores", "composite_scores", "initial_ranking", "extraction_confidence"])
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    plain = lambda rows: sorted((tuple(round(float(v), 6) if not isinstance(v, str) else v for v in r) for r in rows), key=repr)
    assert plain(QUERIES[name](spark, folder).select(*names).collect()) == plain(found.fetchall())


@pytest.mark.parametrize(("edits", "hits"), [("bytes", [4]), ("characters", [0, 4])])
def test_edits_are_of_bytes_or_characters(spark, edits, hits):
    docs = spark.createDataFrame([(0, "ühe"), (4, "the")], "pos long, title string").select("*", *[F.lit("").alias(c) for c in ("snippet", "content", "url")])
    got = bm25f.scores(docs, "the", settings=bm25f.Settings(edits=edits)).where("bm25f > 0").collect()
    assert sorted(r["pos"] for r in got) == hits


# Letters whose case hangs on their neighbours or is two characters in Java, and letters of Unicode 14 to 16.
LETTERS = ["WİTH from", "fromΣ only", "ΑΣ the", "theࡰwith", "onlyꟐ", "with \U00031350from", "fromꟋthe", "theꟜonly", "only with", "the İt"]


@pytest.mark.parametrize("name", ["bm25f_scores", "composite_scores", "initial_ranking"])
def test_letters_are_those_of_the_sql(spark, tmp_path, name):
    rows = [(i, t, "de", f"src{i % 3}", len(t)) for i, t in enumerate(LETTERS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    test_query_equals_its_sql(spark, str(tmp_path), name)
