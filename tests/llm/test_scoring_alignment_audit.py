"""Lattice scores, token alignment and the filter audit against brute-force versions, and their defined results on odd input."""

import hashlib
import math
import random
import zipfile
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from drygrid.llm import exchange, filter_audit, lattice, token_alignment
from drygrid.llm.common import shared_folder, written

WEIGHTS = {b" ": 0.1, b" a": 0.2, b"a": 0.1, b"ab": 0.15, b" ab": 0.1, b"b": 0.05, b"ba": 0.1, b"bab": 0.1, b"c": 0.1}


@pytest.fixture(scope="module")
def tokenizers():
    return token_alignment.Tokenizers(*token_alignment.vocabularies())


# --- exchange ------------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=50, deadline=None)
def test_squeezed_numbers_come_back(values):
    assert exchange.unsqueeze(exchange.squeeze(np.array(values, dtype=np.uint64))).tolist() == values


# --- 11 ------------------------------------------------------------------------------------------------


@given(st.lists(st.text(st.sampled_from("abc"), max_size=9), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_forward_sums_all_segmentations(words):
    net = lattice.Lattice.of(WEIGHTS)
    log = {p: math.log(w) for p, w in WEIGHTS.items()}
    got = np.zeros(len(words))
    for rows, block in lattice.by_length(pa.array([w.encode() for w in words], pa.binary())):
        got[rows] = net.marginal(block)
    for word, value in zip(words, got):
        assert math.exp(value) == pytest.approx(lattice.brute_marginal(word.encode(), log))


@given(st.lists(st.text(st.sampled_from("abc"), min_size=1, max_size=6), min_size=1, max_size=5))
@settings(max_examples=50, deadline=None)
def test_expected_counts_are_those_of_all_segmentations(words):
    net, number = lattice.Lattice.of(WEIGHTS), {p: k for k, p in enumerate(WEIGHTS)}

    def paths(rest):
        return [[]] if not rest else [[rest[:n], *more] for n in range(1, len(rest) + 1) if rest[:n] in WEIGHTS for more in paths(rest[n:])]

    want = np.zeros(len(WEIGHTS))
    for k, word in enumerate(words):
        every = [(math.prod(WEIGHTS[p] for p in path), path) for path in paths(b" " + word.encode())]
        for weight, path in every:
            for p in path:
                want[number[p]] += (k + 1) * weight / sum(w for w, _ in every)
    got = np.zeros(len(WEIGHTS))
    for rows, block in lattice.by_length(pa.array([w.encode() for w in words], pa.binary())):
        got += net.expected(block, rows + 1.0)
    assert got == pytest.approx(want)


def test_every_byte_has_a_path():
    weights = lattice.vocabulary()
    assert sum(weights.values()) == pytest.approx(1) and all(bytes([b]) in weights for b in range(256))
    net = lattice.Lattice.of(weights)
    for rows, block in lattice.by_length(pa.array([b"\xff\xfe\x00", "字🙂".encode(), b"", b"x" * 3000], pa.binary())):
        assert np.isfinite(net.marginal(block)).all()


def test_text_scores(spark, docs, messy, empty, texts):
    for table in (docs, messy):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        got = lattice.text_scores(table).collect()
        assert got and set(got[0].asDict()) == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
        plain = lambda found: sorted([(r[0] is None, r[0] or 0, *r[1:5], round(r[5], 6)) for r in found])
        assert plain([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got]) == plain(lattice.brute_force(rows))
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice.text_scores(empty).collect() == []


def test_scores_are_the_products_of_marginals(spark):
    rows = [(k, " ".join(random.Random(k).choices(["ab", "ba", "abc", "cab", "Abab"], k=6))) for k in range(30)] + [(40, None), (41, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = lattice._chunks(table, "text", "doc_id", lattice.left_out())
    words = exchange.totals(chunks)
    ends = sum(not out for _, out, *_ in lattice.brute_force(rows))
    model = lattice.fit(words, ends, WEIGHTS)
    log = dict(zip(WEIGHTS, model.lattice.log))
    assert sum(map(math.exp, log.values())) + math.exp(model.log_end) == pytest.approx(1)
    got = {r.doc_id: r.score for r in lattice.text_scores(table, weights=WEIGHTS).collect()}
    for k, t in rows:
        want = sum(math.log10(lattice.brute_marginal(w.lower().encode(), log)) for w in (t or "").split()) + model.log_end / math.log(10)
        assert got[k] == pytest.approx(want)


def test_fitting_raises_the_likelihood_of_held_out_texts(spark, docs):
    raw, fitted = ({r.doc_id: r for r in lattice.text_scores(docs, rounds=n).collect()} for n in (0, 2))
    held = [k for k, r in fitted.items() if r.held_out]
    assert held and sum(fitted[k].score for k in held) > sum(raw[k].score for k in held)


# --- 12 ------------------------------------------------------------------------------------------------

ODD = [None, "", " ", "a", "  two  spaces\n\n\tx ", "naïve café 字 and 🙂", "<|endoftext|> in <s> text <0x41>", "▁ is no space", "\x00\x01 control", "don't WE'LL 12345 67", "ünï çödé " * 9, "x" * 700]


def test_alignment_report(spark, tokenizers, texts):
    rows = list(enumerate([*ODD, *[t for _, t in texts if t is None or len(t) < 900], ODD[5], ODD[9], ODD[9]]))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in token_alignment.alignment_report(table).collect())
    assert got == sorted(token_alignment.brute_force(rows, tokenizers))
    by = {r[0]: r for r in got}
    assert by[0][1:] == by[1][1:] == by[7][1:] == (0, 0, 0, 0, 0, 0, "")
    assert all(by[k][1] for k in (2, 3, 4, 5, 6))


def test_alignments_give_links_and_cuts(spark, tokenizers):
    rows = list(enumerate(ODD))
    for r in token_alignment.alignments(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spaced = (" " + (ODD[r.doc_id] or "")).encode()
        spans = []
        for ids, table in ((r.a_ids, tokenizers.a), (r.b_ids, tokenizers.b)):
            assert b"".join(table[i] for i in ids) == (spaced if ids else b"")
            ends = np.cumsum([len(table[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        want = [(i, j) for i, (p, q) in enumerate(spans[0]) for j, (s, t) in enumerate(spans[1]) if p < t and s < q]
        assert [(x.a, x.b) for x in r.links] == want
        assert list(r.cuts) == sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})


@given(st.lists(st.tuples(st.lists(st.integers(1, 5), max_size=12), st.integers(0, 99)), max_size=6))
@settings(max_examples=80, deadline=None)
def test_lockstep_equals_all_pairs(docs):
    """B cuts the same bytes at random other places."""
    a_ends, b_ends, a_first, b_first, want = [], [], [0], [0], Counter()
    for lengths, seed in docs:
        ends = np.cumsum(lengths).tolist()
        other = sorted({*random.Random(seed).sample(range(1, ends[-1] + 1), min(len(lengths), ends[-1])), ends[-1]}) if ends else []
        for i, (p, q) in enumerate(zip([0, *ends], ends)):
            for j, (s, t) in enumerate(zip([0, *other], other)):
                want[a_first[-1] + i, b_first[-1] + j] += p < t and s < q
        a_ends, b_ends = a_ends + ends, b_ends + other
        a_first.append(len(a_ends))
        b_first.append(len(b_ends))
    x, y, a_cut, b_cut = token_alignment.lockstep(*(np.array(v, dtype=np.int64) for v in (a_ends, b_ends, a_first, b_first)))
    assert Counter(zip(x.tolist(), y.tolist())) == +want
    assert a_cut.sum() == b_cut.sum() and len(x) == len(a_ends) + len(b_ends) - a_cut.sum()


def test_alignment_on_odd_tables(spark, messy, empty):
    rows = token_alignment.alignment_report(messy).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in messy.collect())
    assert token_alignment.alignment_report(empty).collect() == [] and token_alignment.alignments(empty).collect() == []


def test_both_libraries_give_the_same_ids(tokenizers):
    for text in ODD[1:]:
        if not token_alignment._UNUSUAL.search(text):
            assert tokenizers.fast.encode_ordinary(" " + text) == tokenizers.slow.encode(" " + text, add_special_tokens=False).ids


# --- 13 ------------------------------------------------------------------------------------------------


def some_documents():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(90)]
    texts = [" ".join(rng.choices(words, k=rng.choice((10, 60, 200)))) + rng.choice(("", " # ", "\x1c", " SHOUT" * 20)) for _ in range(25)] + ["", "A", None]
    rows = [(k, rng.choice(texts), rng.choice(("s1", "s2", "", None))) for k in rng.sample(range(200), 120)]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for k in range(0, 200, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    return rows, labels


def as_dict(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


@pytest.mark.parametrize("order", ["ascending", "descending", "mixed"])
def test_audit_over_micro_batches(spark, tmp_path, order):
    """Smaller ids come before, after or among larger ones: earlier counts are taken back."""
    rows, labels = some_documents()
    if order != "mixed":
        rows.sort(key=lambda r: r[0], reverse=order == "descending")
    rows += [rows[5], rows[5], (None, rows[0][1], "s1"), (None, rows[0][1], "s1")]
    for k in range(0, len(rows), 20):
        spark.createDataFrame(rows[k : k + 20], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counted = filter_audit.counters(filter_audit.files(spark, str(tmp_path / "docs"), 1), said)
    assert sum(r.n for r in counted.collect()) == len(rows)
    assert as_dict(filter_audit.audit(counted).collect()) == filter_audit.brute_force(rows, labels)


def test_audit_of_tables(spark, messy, empty):
    labels = spark.createDataFrame([(5, 1, 0), (30, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in messy.collect()]
    found = filter_audit.audit(filter_audit.counters(messy, labels)).collect()
    assert as_dict(found) == filter_audit.brute_force(rows, [tuple(r) for r in labels.collect()])
    assert filter_audit.audit(filter_audit.counters(empty, labels)).collect() == []
    assert filter_audit.audit(filter_audit.counters(messy, labels.limit(0))).agg({"good_lost": "sum"}).first()[0] == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "unset") == spark.newSession().conf.get("spark.sql.streaming.stateStore.providerClass", "unset")


def test_state_partitions_reserve_no_disk(spark):
    """A store writes the settings it ran with beside its state."""
    before = set(Path(shared_folder(spark)).glob("audit-*"))
    rows, said = spark.createDataFrame([(1, "a b", "p")], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    filter_audit.counters(rows, said).collect()
    [folder] = set(Path(shared_folder(spark)).glob("audit-*")) - before
    options = [z.read(n).decode() for z in map(zipfile.ZipFile, folder.glob("progress/state/*/*/*.zip")) for n in z.namelist() if n.startswith("OPTIONS")]
    assert options and all("allow_fallocate=false" in x for x in options)


def test_a_frequent_text_is_combined_before_the_shuffle(spark):
    rows = pa.RecordBatch.from_pylist([{"id": 1000 - k, "part": "s", "name": hashlib.sha256(b"x").digest(), "mask": 1} for k in range(500)],
                                      schema=pa.schema([("id", pa.int64()), ("part", pa.string()), ("name", pa.binary()), ("mask", pa.int32())]))
    [out] = list(filter_audit._combine(iter([rows, rows])))
    assert out.to_pylist() == [{"name": hashlib.sha256(b"x").digest(), "part": "s", "mask": 1, "id": 501, "least": 2, "n": 1000}]


def test_shapley_adds_up(spark):
    rows, labels = some_documents()
    tables = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = written(filter_audit.audit(filter_audit.counters(*tables))).collect()
    for part in {r.part for r in found}:
        mine = [r for r in found if r.part == part and r.filter_order == "ABCDE"]
        assert sum(r.shapley for r in mine) == 120 * sum(r.removed for r in mine)
