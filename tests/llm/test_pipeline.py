"""The pipeline and the registered queries."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from drygrid.llm import containment, factorisation, line_alignment, setsketch
from drygrid.llm.common import written

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@needs_tables
def test_stages_leave_clashing_columns_alone(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", "-1.5d score", "concat('l', doc_id) n_lines", "-7 n_removed")
    for stage in (corpus_pipeline.quality, corpus_pipeline.lines):
        docs = written(stage(spark, docs, FOLDER))
        rows = docs.select("doc_id", "score", "n_lines", "n_removed").collect()
        assert rows and {(r.score, r.n_lines, r.n_removed) for r in rows} == {(-1.5, f"l{r.doc_id}", -7) for r in rows}


@needs_tables
def test_stages_keep_what_their_rule_keeps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    benchmark = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, FOLDER))
        rows = docs.collect()
        texts = sorted((k, r.text) for k, r in before.items())
        if name == "best-fit packing":
            assert {r.doc_id for r in rows} == set(before)
            continue
        assert docs.columns == columns and len({r.doc_id for r in rows}) == len(rows)
        after = {r.doc_id: r for r in rows}
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            assert all(k in after for k in before if labels.get(k) == 1)
        elif name == "line dedup":
            want = {k: t for k, n, m, t in line_alignment.brute_force(texts) if m == 0 or m < n}
            assert {k: r.text or "" for k, r in after.items()} == want
        elif name == "MinHash near-dedup":
            assert set(after) == {k for k, _, _, stay in setsketch.brute_force(texts, corpus_pipeline.SIMILARITY) if stay}
        else:
            assert set(after) == set(before) - {k for k, *_ in containment.brute_force(texts, benchmark)}


@needs_tables
def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
    pick = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pick(corpus_pipeline.run(spark, FOLDER)) == pick(docs)


def test_stages_survive_odd_tables(spark, messy, empty, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(5, 1, 0), (30, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "two words"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for table in (messy, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, folder))
            if name != "best-fit packing":
                assert out.columns == table.columns
                docs = out if name != "quality classifier" else docs  # the tiny classifier may reject anything
        assert (out.count() == 0) == (table is empty)


@needs_tables
@pytest.mark.parametrize("name", sorted(n for n in entry_module.queries() if n.startswith("op") and n[2].isdigit()))
def test_registered_queries_cover_their_tables(spark, name):
    rows = entry_module.queries()[name](spark, FOLDER).collect()
    if name.startswith("op13_"):
        assert sum(r.kept + r.removed for r in rows if r.filter_order == "ABCDE" and r.step == 1) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
        return
    table, key = ("pages", "page_id") if name.startswith("op10_") else ("documents", "doc_id")
    every = {r[key] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").collect()}
    assert {r[key] for r in rows} <= every
    if not name.startswith("op9_"):
        assert {r[key] for r in rows} == every


@needs_tables
def test_held_out_accuracy(spark):
    import numpy as np

    folder = FOLDER.replace("sf0.001", "sf0.1")
    scored = factorisation.op1(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.97
    rank = np.argsort(np.argsort(scored.score.to_numpy())) / len(scored)
    assert rank[scored.quality == 1].mean() - rank[scored.quality == 0].mean() > 0.48
