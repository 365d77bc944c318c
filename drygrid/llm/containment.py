"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are partitioned by the size of their shingle sets, in powers of two. For a partition of items up to ``s`` shingles
every document is cut into windows of two neighbouring chunks of ``s`` shingles, so a passage as long as an item lies inside some
window and the two sets are of similar size: containment of 0.8 then means a similarity of 0.19 at least. Windows and items that
agree in one of ``HASHES`` minima are candidates (missed with probability 1.4e-6 at that least similarity); minima of larger windows
are minima of smaller ones' minima. A candidate counts only if the document's whole shingle set contains the item's.

The benchmark is the stated query set. It is taken in blocks of bounded size; each block is broadcast and meets all documents, so
documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drygrid.llm.common import distinct_per_document, find_words, lean, mix, pieces, shingles, text_bytes

WORDS, HASHES, CONTAINED = 5, 64, 80
BLOCK_ITEMS, BLOCK_CHARS = 4096, 16 << 20
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
_BITS = 22


class Index:
    """Items of one block: shingle sets, and the minima of each size partition."""

    def __init__(self, items: list[tuple], threshold: int = CONTAINED) -> None:
        self.ids, self.threshold = [k for k, _ in items], threshold
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        hashes, doc = shingles(find_words(data, offsets, lower=True), WORDS)
        values, first = distinct_per_document(hashes, doc, len(items))
        self.sets = [values[a:b] for a, b in zip(first, first[1:])]
        self.partitions: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        size = np.diff(first)
        partition = np.where(size > 0, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), -1)
        for c in np.unique(partition[partition >= 0]).tolist():
            members = np.flatnonzero(partition == c)
            keys = np.concatenate([_keys(np.array([(self.sets[m] * f).min() for f in _FACTORS])[:, None])[:, 0] for m in members])
            owner = np.repeat(members, HASHES)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.partitions[c] = keys[order], owner[order], seen

    def candidates(self, hashes: np.ndarray, doc: np.ndarray, documents: int) -> set[tuple[int, int]]:
        """Pairs (document, item) that agree in some minimum."""
        out: set[tuple[int, int]] = set()
        if not len(hashes) or not self.partitions:
            return out
        finest = min(self.partitions)
        begin = np.searchsorted(doc, np.arange(documents))
        chunk = (np.arange(len(doc)) - begin[doc]) >> finest
        edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (chunk[1:] != chunk[:-1]))))
        minima = np.stack([np.minimum.reduceat(hashes * f, edge) for f in _FACTORS])
        doc, chunk = doc[edge], chunk[edge]
        for c in range(finest, max(self.partitions) + 1):
            if c > finest:
                chunk = chunk >> 1
                edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (chunk[1:] != chunk[:-1]))))
                minima = np.minimum.reduceat(minima, edge, axis=1)
                doc, chunk = doc[edge], chunk[edge]
            if c in self.partitions:
                keys, owner, seen = self.partitions[c]
                window = minima.copy()
                joined = np.flatnonzero(doc[1:] == doc[:-1])
                window[:, joined] = np.minimum(minima[:, joined], minima[:, joined + 1])
                found = _keys(window)
                row, column = np.nonzero(seen[(found >> np.uint64(64 - _BITS)).astype(np.int64)])
                asked = found[row, column]
                low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
                for k in np.flatnonzero(high > low).tolist():
                    out.update((int(doc[column[k]]), int(m)) for m in owner[low[k] : high[k]])
        return out

    def contained(self, hashes: np.ndarray, doc: np.ndarray, documents: int) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of all contained items, confirmed on whole sets."""
        out, last, own = [], -1, None
        begin = np.searchsorted(doc, np.arange(documents + 1))
        for d, item in sorted(self.candidates(hashes, doc, documents)):
            if d != last:
                last, own = d, np.unique(hashes[begin[d] : begin[d + 1]])
            at = np.minimum(np.searchsorted(own, self.sets[item]), len(own) - 1)
            shared = int((own[at] == self.sets[item]).sum())
            if 100 * shared >= self.threshold * len(self.sets[item]):
                out.append((d, item, shared))
        return out


def _keys(minima: np.ndarray) -> np.ndarray:
    """Minima of different hash functions (rows) as one key space."""
    return mix(minima + np.arange(1, HASHES + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))


def _blocks(benchmark: DataFrame, text: str, key: str) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters, one at a time on the driver."""
    items = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").distinct()
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect()
        if rows:
            yield sorted(((r.k, r.t) for r in rows), key=repr)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", threshold: int = CONTAINED) -> DataFrame:
    """Rows key, item key, ``n_item``, ``n_shared``, ``containment``: every item at least ``threshold`` percent contained in a document.

    Words are lower-cased (A-Z) runs of non-space, shingles have five words, shorter texts are one shingle. NULL and empty texts and
    items match nothing; repeated documents give repeated rows, items repeated under one key count once. Empty tables give no rows.
    """
    lean(docs.sparkSession)
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, n_item long, n_shared long, containment double"
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_text, item_key):
        out = out.unionByName(rows.mapInArrow(_search(docs, items, threshold, benchmark.schema[item_key].dataType), schema.replace(f"`{key}`", "a").replace(f"`{item_key}`", "b")).toDF(key, item_key, "n_item", "n_shared", "containment"))
    return out


def _search(docs: DataFrame, items: list[tuple], threshold: int, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    shared, arrow = docs.sparkSession.sparkContext.broadcast(items), to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, threshold)
        for rows, data, offsets in pieces(batches, "_text"):
            found = index.contained(*shingles(find_words(data, offsets, lower=True), WORDS), rows.num_rows)
            d, m, n = (np.array(x, dtype=np.int64) for x in (zip(*found) if found else ((), (), ())))
            size = np.array([len(index.sets[i]) for i in m], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(d)), pa.array([index.ids[i] for i in m], arrow), pa.array(size), pa.array(n), pa.array(n / np.maximum(size, 1))],
                                             names=["a", "b", "n_item", "n_shared", "containment"])
    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", threshold: int = CONTAINED) -> DataFrame:
    """The rows of ``docs`` (same columns) that contain no benchmark item. Rows are filtered where they lie."""
    lean(docs.sparkSession)
    schema = docs.schema
    for items in _blocks(benchmark, item_text, item_key):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, threshold)
            for rows, data, offsets in pieces(batches, text):
                clean = np.ones(rows.num_rows, dtype=bool)
                clean[[d for d, _, _ in index.contained(*shingles(find_words(data, offsets, lower=True), WORDS), rows.num_rows)]] = False
                yield rows.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs


def op9(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def brute_force(texts: list[tuple], items: list[tuple], threshold: int = CONTAINED) -> list[tuple]:
    """The same on plain sets; for tests."""
    def of(t):
        words = (t or "").encode().lower().split()
        return {tuple(words[i : i + WORDS]) for i in range(max(len(words) - WORDS + 1, 1))} if words else set()
    sets = [(i, of(t)) for i, t in items]
    return [(k, i, len(s), len(s & own)) for k, t in texts for own in [of(t)] for i, s in sets if s and 100 * len(s & own) >= threshold * len(s)]
