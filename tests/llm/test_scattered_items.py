"""Benchmark items that are cut into pieces spread over a long document."""

import numpy as np
import pytest

from drygrid.llm import containment

PIECES = (1, 2, 4, 8, 16)


def scattered(rng, n_items, item_words, doc_words, n_pieces):
    """Items and, for each, a document that holds its pieces in order, at random places between words of its own."""
    items, docs = [], []
    for k in range(n_items):
        item = [f"w{x}" for x in rng.integers(0, 5000, item_words)]
        own = [f"v{x}" for x in rng.integers(0, 5000, doc_words - item_words)]
        cuts = np.sort(rng.choice(np.arange(10, item_words // 5 - 10), n_pieces - 1, replace=False) * 5) if n_pieces > 1 else []
        places = np.sort(rng.integers(0, len(own), n_pieces))
        text, last = [], 0
        for piece, at in zip(np.split(np.array(item, dtype=object), cuts), places):
            text += own[last:at] + list(piece)
            last = at
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(text + own[last:])))
    return items, docs


@pytest.mark.parametrize("doc_words", [2000, 10000])
def test_recall_of_scattered_items(spark, doc_words):
    rng = np.random.default_rng(doc_words)
    items, docs, pieces = [], [], {}
    for n in PIECES:
        some, of = scattered(rng, 30, 800, doc_words, n)
        base = len(items)
        items += [(base + k, t) for k, t in some]
        docs += [(base + k, t) for k, t in of]
        pieces.update({base + k: n for k, _ in some})
    want = {(k, i): (n, m) for k, i, n, m in containment.brute_force(docs, items)}
    assert {k for k, _ in want} == set(pieces)
    table = [spark.createDataFrame(rows, schema) for rows, schema in ((docs, "doc_id long, text string"), (items, "item_id long, text string"))]
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in containment.contamination(*table).collect()}
    assert all(want[pair] == counts for pair, counts in got.items())
    recall = {n: np.mean([(k, k) in got for k in pieces if pieces[k] == n]) for n in PIECES}
    print("recall by pieces", recall)
    assert min(recall.values()) >= 0.9, recall
