"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontam


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
    good, lined, single, clean = (kept[n] for n in ("quality_rules", "line_dedup", "near_dedup", "decontamination"))
    assert good.count() == lined.count() >= single.count() >= clean.count() > 0
    texts = {r["doc_id"]: r["text"] for r in lined.collect()}
    left = {r["doc_id"] for r in single.collect()}

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = {i: shingles(t) for i, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert max(Counter(texts[i] for i in left).values()) == 1
    ordered = sorted(left)
    assert not [(a, b) for k, a in enumerate(ordered) for b in ordered[k + 1 :] if alike(a, b) >= 0.8]
    for gone in set(texts) - left:  # what went is like something
        assert max(alike(gone, i) for i in texts if i != gone) >= 0.8
    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for r in clean.collect():
        joined = " " + " ".join(decontam.words_of(r["text"])) + " "
        assert not any(" " + " ".join(x) + " " in joined for x in items)
    packed = kept["best_fit_packing"]
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_run_equals_stages(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


ODD = [
    (None, "a text without an id that has words enough to be a document of its own and passes, as it says that it does, with more than twenty of them"),
    (1, None), (2, ""), (3, " \n\t "), (4, "𝒳 É"), (5, "word " * 30_000), (6, " ".join(f"w{i}" for i in range(20_000))),
    (7, " ".join(f"twin{i}" for i in range(60))), (7, " ".join(f"twin{i}" for i in range(60))), (8, " ".join(f"twin{i}" for i in range(60))),
]
CLASHES = ("gone", "host", "key", "address", "ledger", "line", "boilerplate_host", "boilerplate_lines", "leaking_text", "rank", "item_id", "row")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, data, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(i, t, "en" if i != 2 else None, None if i == 4 else "s", len(t or "")) for i, t in ODD]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = table.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    out = stage(spark, odd, data)
    got = Counter(r["doc_id"] for r in out.collect())
    every = Counter(i for i, _ in ODD)
    if name == "quality_rules":
        assert got == Counter({None: 1, 6: 1, 7: 2, 8: 1})
    elif name == "near_dedup":
        assert got == every - Counter({2: 1, 3: 1, 8: 1})
    elif name == "best_fit_packing":
        assert all(got[i] >= n for i, n in every.items()) and got[1] == got[2] == 1 and got[6] > 20
    else:
        assert got == every
    if name != "best_fit_packing":
        assert out.columns == odd.columns
    assert stage(spark, odd.limit(0), data).count() == 0


def test_empty_benchmark_drops_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert decontam.drop_leaking(docs, spark.read.parquet(f"{data}/benchmark.parquet").limit(0)).count() == docs.count()
