"""Tables that grow with the corpus are never broadcast, however small the planner takes them for."""

import numpy as np
import pytest
from pyspark.sql.streaming import DataStreamWriter

from drygrid.llm import common, components, exchange, filter_audit, line_alignment, packing, setsketch
from tests.llm.conftest import sentence


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plan of each table that is written, before it runs."""
    found = []

    def written(df):
        found.append(plan(df))
        return common.written(df)

    for module in (components, exchange, filter_audit, line_alignment, packing, setsketch):
        if hasattr(module, "written"):
            monkeypatch.setattr(module, "written", written)
    return found


def test_labels_meet_a_stream_by_a_shuffle(spark, monkeypatch, capsys):
    started, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **b: started.append(start(self, *a, **b)) or started[-1])
    rows, said = spark.createDataFrame([(1, "a b", "p"), (2, "a b", "p")], "doc_id long, text string, source string"), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert sum(r.n for r in filter_audit.counters(rows, said).collect()) == 2
    capsys.readouterr()
    started[0].explain()
    shown = capsys.readouterr().out
    assert "SortMergeJoin" in shown and "Broadcast" not in shown


def crowded(spark):
    """Texts around one passage, and chains of copies: all steps of the search have rows."""
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(60)]
    texts = [(i, " ".join([f"a{rng.integers(1e9)}" for _ in range(int(rng.integers(2, 9)))] + passage + [f"b{rng.integers(1e9)}" for _ in range(int(rng.integers(2, 9)))])) for i in range(40)]
    words = [f"c{i}" for i in range(300)]
    for i in range(15):
        words = words[:]
        words[(i * 37) % 300] = f"d{i}"
        texts.append((100 + (i * 11) % 15, " ".join(words)))
    return texts, spark.createDataFrame(texts, "doc_id long, text string")


def test_near_duplicates_meet_by_a_shuffle(spark, monkeypatch, plans):
    monkeypatch.setattr(common, "FEW", -1, raising=False)
    texts, docs = crowded(spark)
    found = setsketch.keep_one(docs)
    plans.append(plan(found))
    assert sum("SortMergeJoin" in p for p in plans) > 10 and not any("Broadcast" in p for p in plans)
    assert sorted(r.doc_id for r in found.collect()) == sorted(k for k, _, _, stay in setsketch.brute_force(texts) if stay)


def test_lines_and_packed_pieces_meet_by_a_shuffle(spark, monkeypatch, plans):
    monkeypatch.setattr(common, "FEW", -1, raising=False)
    docs = spark.createDataFrame([(k, "\n".join([sentence(1, 12), sentence(k, 12)])) for k in range(8)], "doc_id long, text string")
    found = line_alignment.line_dedup(docs)
    assert sum(r.n_removed for r in found.collect()) >= 7
    packed = packing.pack(docs)
    assert {r.doc_id for r in packed.collect()} == set(range(8))
    plans += [plan(found), plan(packed)]
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
