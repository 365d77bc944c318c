"""Near-duplicate groups by SetSketch registers.

A register holds ``floor(1 - log_b(x / a))`` of the least of the exponential values that a hash function gives a document's shingles,
truncated to 16 bits. Registers of a union are the register-wise maximum, so sketches merge; equal registers are about as likely as
the similarity, so bands of them serve as search keys; and from the counts of smaller, equal and larger registers the similarity of
two sets of known sizes is estimated jointly by maximum likelihood.

1. Documents with equal shingle sets form classes, named by size and hashes of the set, so NULL and repeated keys are searched like
   others. One row of each class gives its text.
2. In every band bucket the smallest name is paired with each other member (never all pairs of a bucket).
3. Pairs whose estimate is five standard errors below the threshold are dropped, the rest compared on their full sets.
4. Buckets whose members are still in several components hold texts that share a common passage, or copies just below the
   threshold. Their members are searched exactly: sets are ordered from rare to frequent shingles, and two sets that reach the
   threshold share one of the first few, near enough to the front that the rest can still make up the intersection. How many sets have
   a shingle is counted exactly; one that no other set has can't be shared, so texts that differ by too many own shingles never meet.
   The most central member of each shingle is compared with the others first; then what is still in different components. No bucket is capped.

A link at the threshold itself shares a bucket with probability 1 - 2.6e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from drygrid.llm.common import TAG, distinct_per_document, find_words, lean, lists, mix, null_safe, pieces, row_tag, shingles, shuffled, sized, written
from drygrid.llm.components import components
from drygrid.llm.exchange import Part, answered, chunked, fields, totals

WORDS, BANDS, ROWS = 5, 32, 6
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1
_FACTORS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (documents x ``REGISTERS``) of shingle sets; zeros for an empty set."""
    out = np.zeros((len(first) - 1, REGISTERS), dtype=np.uint16)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        for i, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(values * factor, first[some])
            spacing = -np.log1p(-(np.minimum(least, np.uint64((1 << 64) - 2048)).astype(np.float64) + 0.5) / 2.0**64)
            out[some, i] = np.clip(np.floor(1 - np.log(spacing / RATE) / np.log(BASE)), 0, LIMIT)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches whose sets have the sizes ``n_a`` and ``n_b``."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less

    def likelihood(j):
        def p(x):
            return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):
        third = (high - low) / 3
        rising = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(rising, low + third, low), np.where(rising, high, high - third)
    return (low + high) / 2


@F.arrow_udf(T.DoubleType())
def _similarity(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.float64())
    left, right = (np.frombuffer(b"".join(x.to_pylist()), dtype=np.uint16).reshape(len(x), REGISTERS) for x in (a, b))
    return pa.array(estimate(left, right, n_a.to_numpy(zero_copy_only=False).astype(float), n_b.to_numpy(zero_copy_only=False).astype(float)))


def _sets(batches: Iterator[pa.RecordBatch]):
    for rows, data, offsets in pieces(batches):
        hashes, doc = shingles(find_words(data, offsets, lower=True), WORDS)
        yield rows, *distinct_per_document(hashes, doc, rows.num_rows)


def _names(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Names of shingle sets, 24 bytes each: size and two sums of hashes."""
    total, other = (np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64))) for x in (values, mix(values ^ np.uint64(77))))
    name = np.stack([np.diff(first).astype(np.uint64), *(x[first[1:]] - x[first[:-1]] for x in (total, other))], axis=1)
    return pa.array([row.tobytes() for row in name], pa.binary())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, values, first in _sets(batches):
        signs = [r.tobytes() for r in registers(values, first)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(first)), _names(values, first), pa.array(signs, pa.binary())],
                                         names=["doc_id", TAG, "n", "id", "registers"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, values, first in _sets(batches):
        yield pa.RecordBatch.from_arrays([_names(values, first), lists(pa.array(values.view(np.int64)), first)], names=["id", "items"])


def _items(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows ``id`` and ``items`` (the full set) of the classes ``wanted``: ``rep`` is the row that gives the text, ``copies`` its number of rows."""
    wanted = written(wanted.select("id", F.col("rep.doc_id").alias("doc_id"), F.col(f"rep.{TAG}").alias(TAG), F.col("rep.copies").alias("copies")))
    found = null_safe(rows, sized(wanted.filter("copies = 1").select("doc_id", TAG), wanted), ("doc_id", TAG), "left_semi")
    again = sized(wanted.filter("copies > 1").select("doc_id", TAG), wanted)
    if not again.isEmpty():
        found = found.unionByName(null_safe(rows, again, ("doc_id", TAG), "left_semi").dropDuplicates(["doc_id", TAG]))
    return found.select("text").mapInArrow(_full, "id binary, items array<long>")


def near_duplicates(docs: DataFrame, threshold: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, ``_row_tag`` (names the text), ``n_shingles``, ``component_id`` and ``kept``.

    Words are lower-cased (A-Z) runs of non-space; a document is the set of its distinct runs of five words (with fewer words: all of
    them as one). Documents are linked if 100 * intersection >= ``threshold`` * union, confirmed on full sets. ``component_id`` is
    the smallest key that links reach; one text of it is ``kept``, that of the smallest key (of several texts under that key, the one with
    the least tag). Empty and NULL texts are linked with nothing and kept. A row with a NULL key joins its component but never names one;
    a component of NULL keys only is NULL and keeps one text too. Repeated rows share their result; texts under one key are compared like
    any others. Thresholds of 80 and more keep the stated recall.
    """
    lean(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), row_tag(text).alias(TAG), F.col(text).alias("text"))
    found = written(rows.mapInArrow(_sketch, f"doc_id {kind}, {TAG} long, n long, id binary, registers binary"))
    alike = found.filter("n > 0").groupBy("id", "doc_id", TAG).agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.first("registers").alias("registers"))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", TAG, "copies")
    nodes = written(alike.groupBy("id").agg(F.first("n").alias("n"), F.min(row).alias("rep"), F.first("registers").alias("registers")))

    band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])).alias("bucket")
    entries = nodes.select("id", "n", band)
    # written before it is joined: a join of two plain shuffles can be split where a bucket is very large
    leaders = written(entries.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("size")).filter("size > 1").drop("size"))
    crowded = written(entries.join(sized(leaders), "bucket"))
    first = _verified(rows, nodes, crowded.filter("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")), threshold)
    links = written(first)

    of = components(links)
    placed = crowded.join(sized(of), "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("bucket")
    extra = written(_rest(rows, nodes, placed.join(sized(open_, leaders), "bucket").select("id", "n", "component").distinct(), threshold))
    if not extra.isEmpty():
        of = components(links.unionByName(extra))

    # the row that names a component; written before it is joined, so a join can be split at a large component
    named = nodes.select("id", "rep").join(sized(of), "id")
    best = written(named.groupBy("component").agg(F.min("rep").alias("best")))
    first_of = nodes.select("id", "rep").join(sized(named.select("id", "component").join(sized(best), "component").select("id", "best"), of), "id", "left")
    first_of = written(first_of.select("id", F.coalesce("best", "rep").alias("best")))
    member = found.select("doc_id", TAG, "n", "id").join(shuffled(first_of), "id", "left")
    own = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col(TAG) == F.col(f"best.{TAG}"))
    return member.select(F.col("doc_id").alias(key), TAG, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                         ((F.col("n") == 0) | own).alias("kept"))


def _rest(rows: DataFrame, nodes: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Links between different components among ``members`` (id, n, component), by prefixes of their sets from rare to frequent.

    First one member of each prefix item meets the others: the one that has the fewest rarer items, the text which copies stem from if there
    is one. What is still in different components then is paired.
    """
    members = written(members)
    sets = written(_items(rows, nodes.join(sized(members.select("id")), "id", "left_semi")).join(sized(members.select("id", "component")), "id"))
    fronts = written(_fronts(sets, threshold))
    row = F.struct("place", "id", "component", "n")
    # written before it is joined: a join of two plain shuffles can be split at a frequent item
    centres = written(fronts.groupBy("item").agg(F.min(row).alias("c"), F.count("*").alias("size")).filter("size > 1").select("item", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("id", "component", "n", "place")]))
    met = fronts.join(sized(centres), "item").filter((F.col("component") != F.col("c_component")) & _reachable(threshold, "n", "place", "c_n", "c_place"))
    near = written(_compared(met.select(F.least("id", "c_id").alias("a"), F.greatest("id", "c_id").alias("b")).distinct(), sets, threshold))

    label = sized(members.select("id", "component"))
    joined = near.join(label.withColumnsRenamed({"id": "a", "component": "x"}), "a").join(label.withColumnsRenamed({"id": "b", "component": "y"}), "b")
    wider = components(joined.select("x", "y"), "x", "y").select(F.col("id").alias("component"), F.col("component").alias("wider"))
    placed = written(fronts.join(sized(wider), "component", "left").withColumn("component", F.coalesce("wider", "component")).drop("wider"))
    open_ = written(placed.groupBy("item").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("item"))
    placed = written(placed.join(sized(open_), "item", "left_semi"))
    left, right = placed.alias("l"), sized(placed).alias("r")
    pairs = left.join(right, (F.col("l.item") == F.col("r.item")) & (F.col("l.component") != F.col("r.component")) & (F.col("l.id") < F.col("r.id"))
                      & _reachable(threshold, "l.n", "l.place", "r.n", "r.place")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    return near.unionByName(_compared(pairs, sets, threshold))


def _reachable(threshold: int, n: str, place: str, other_n: str, other_place: str):
    """Whether two sets can reach the threshold when a common item stands at these places and no rarer one is common."""
    most = F.least(F.col(n) - F.col(place), F.col(other_n) - F.col(other_place))
    return F.lit(100 + threshold) * most >= F.lit(threshold) * (F.col(n) + F.col(other_n))


def _fronts(sets: DataFrame, threshold: int) -> DataFrame:
    """The first items of each set from rare to frequent, as many as two sets that reach the threshold need to share one.

    How many sets have an item is counted exactly, through chunk dictionaries. Items of one set only keep their places but are left out.
    """
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part]]:
        for batch in batches:
            items, size = batch.column(1), batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            entries, numbers = np.unique(items.flatten().to_numpy(zero_copy_only=False), return_counts=True)
            place = np.searchsorted(entries, items.flatten().to_numpy(zero_copy_only=False))
            yield 8 * len(place), Part(batch.column(0), batch.column(2), entries, entries.view(np.uint64), numbers, np.concatenate(([0], np.cumsum(size))), place, np.ones(len(place), np.int64))

    def front(keys: pa.Array, marks: pa.Array, doc: np.ndarray, place: np.ndarray, times: np.ndarray, table: pa.Table) -> pa.Table:
        held, item = (table.column(c).to_numpy()[place] for c in ("n", "item"))
        order = np.lexsort((item, held, doc))
        size = np.bincount(doc, minlength=len(keys))
        at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        keep = (at < (size + (-threshold * size) // 100 + 1)[doc]) & (held[order] > 1)
        of = pa.array(doc[keep])
        return pa.table({"id": keys.take(of), "component": marks.take(of), "item": item[order][keep], "n": size[doc[keep]], "place": at[keep]})

    chunks = written(sets.select("id", "items", "component").mapInArrow(lambda batches: chunked(parts(batches), pa.int64(), pa.binary()), fields("binary", "long", "binary")))
    counted = written(totals(chunks).withColumn("item", F.col("entry")))
    return answered(chunks, counted, front, "id binary, component binary, item long, n long, place long")


def _compared(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    first, second = (shuffled(sets.select(F.col("id").alias(x), F.col("items").alias(y))) for x, y in ("ax", "by"))
    both = pairs.join(first, "a").join(second, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(F.lit(100) * common >= F.lit(threshold) * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def _verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that are links: first by the joint estimate of their sketches, then on full sets."""
    floor = threshold / 100 - 5 * (threshold / 100 * (1 - threshold / 100) / REGISTERS) ** 0.5
    side = [shuffled(nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))) for x in "ab"]
    likely = written(pairs.distinct().join(side[0], "a").join(side[1], "b").filter(_similarity("r_a", "r_b", "n_a", "n_b") >= floor).select("a", "b").distinct())
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    return _compared(likely, _items(rows, nodes.join(sized(wanted, likely), "id", "left_semi")), threshold)


def keep_one(docs: DataFrame, threshold: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` (same columns) that stay when each group of near duplicates keeps its smallest key, each once."""
    columns = docs.columns
    kept = near_duplicates(docs, threshold, text, key).filter("kept").select(F.col(key).alias("_key"), F.col(TAG).alias("_kept_tag")).distinct()
    tagged = docs.withColumn(TAG, row_tag(text))
    found = tagged.join(shuffled(kept), tagged[key].eqNullSafe(kept["_key"]) & (tagged[TAG] == kept["_kept_tag"]), "left_semi")
    return found.dropDuplicates([key, TAG]).select(*columns)


def op6(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def brute_force(texts: list[tuple[int, str | None]], threshold: int = 85) -> list[tuple[int, int, int, bool]]:
    """The same from an inverted index over all shingles; for tests."""
    sets, holders = {}, {}
    for k, t in texts:
        words = (t or "").encode().lower().split()
        sets[k] = {tuple(words[i : i + WORDS]) for i in range(max(len(words) - WORDS + 1, 1))} if words else set()
        for s in sets[k]:
            holders.setdefault(s, []).append(k)
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, own in sets.items():
        shared: dict[int, int] = {}
        for s in own:
            for other in holders[s]:
                if other < k:
                    shared[other] = shared.get(other, 0) + 1
        for other, n in shared.items():
            if 100 * n >= threshold * (len(own) + len(sets[other]) - n):
                x, y = sorted((top(k), top(other)))
                root[y] = x
    return [(k, len(sets[k]), top(k), top(k) == k) for k, _ in texts]
