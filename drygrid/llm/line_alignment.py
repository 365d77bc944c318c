"""Line de-duplication by pairwise alignment.

A block is a run of consecutive lines with at least ``least_words`` words. A line leaves the later document if it lies in a block that
an earlier document holds as well.

1. Evidence: each line names the shortest block that begins with it and the shortest one that ends with it. A line of a longer block lies
   in one of these that the longer block contains, so two documents hold a common block exactly if they share a shortest one, whatever
   the frequency or length of the lines.
2. Pairs: each document meets the earliest holder of each of its shortest blocks, so pairs are at most as many as lines, never all holders of one.
3. Each pair's line names are aligned with patience diff: lines unique on both sides are anchors, the longest increasing chain of them cuts the
   pair into ranges, and so on. Where a range has no unique line, a shortest block that both sides hold is the anchor, and the block grows
   from there as far as both agree; this goes on until no common block is left that isn't marked.
4. The marked lines leave the later document.

Lines are compared by their words; lines without words are never compared nor removed. Line names travel, texts do not.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from drygrid.llm.common import TAG, Prefix, find_words, lean, lists, null_safe, pieces, release, row_tag, shuffled, sized, written

LEAST_WORDS = 10


def shortest(words: np.ndarray, doc: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of the shortest blocks that begin or end with a line, each once; ``words`` and ``doc`` of all lines."""
    total = np.concatenate(([0], np.cumsum(words)))
    first, last = np.searchsorted(doc, doc), np.searchsorted(doc, doc, side="right")
    place = np.arange(len(words))
    stop = np.searchsorted(total, total[:-1] + least_words)  # forward: least end with enough words
    start = np.searchsorted(total, total[1:] - least_words, side="right") - 1  # backward: greatest begin
    ahead, back = stop <= last, start >= first
    begins, ends = np.concatenate((place[ahead], start[back])), np.concatenate((stop[ahead], place[back] + 1))
    order = np.lexsort((ends, begins))
    begins, ends = begins[order], ends[order]
    once = np.ones(len(begins), dtype=bool)
    once[1:] = (begins[1:] != begins[:-1]) | (ends[1:] != ends[:-1])
    return begins[once], ends[once]


def line_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name and number of words of every line with words, and its document."""
    words = find_words(data, offsets)
    breaks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0]
    line = np.searchsorted(breaks, words.start) + words.doc * (len(breaks) + 1)
    begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(line)) if len(begin) else begin
    return Prefix(words.name).span(begin, end), end - begin, words.doc[begin]


def _lines(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document: key, tag, names and words of its lines with words, hashes of its shortest blocks."""
        for rows, data, offsets in pieces(batches, "_text"):
            names, words, doc = line_names(data, offsets)
            start, stop = shortest(words, doc, least_words)
            block = Prefix(names).span(start, stop)
            every = np.arange(rows.num_rows + 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), lists(pa.array(names.view(np.int64)), np.searchsorted(doc, every)), lists(pa.array(words.astype(np.int32)), np.searchsorted(doc, every)),
                 lists(pa.array(block.view(np.int64)), np.searchsorted(doc[start], every))], names=["_key", TAG, "names", "words", "blocks"])
    return run


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences of line names by patience diff, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        unique = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in where]
        anchors = _increasing(unique)
        if not anchors:
            continue
        i0, j0 = a0, b0
        for i, j in anchors:
            todo.append((i0, i, j0, j))
            out.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(out)


def _increasing(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain with both numbers increasing (points come sorted by the first)."""
    tails, at, before = [], [], []
    for k, (_, j) in enumerate(points):
        p = bisect.bisect_left(tails, j)
        before.append(at[p - 1] if p else -1)
        tails[p : p + 1] = [j]
        at[p : p + 1] = [k]
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(points[k])
        k = before[k]
    return chain[::-1]


def common_blocks(later: list[tuple[int, int]], earlier: list[tuple[int, int]], words: dict[int, int], least_words: int) -> list[int]:
    """Places in the later document of the aligned blocks that are long enough. Input: (place, line name), sorted."""
    out, block, size = [], [], 0
    previous = (-2, -2)
    for i, j in patience([x for _, x in later], [x for _, x in earlier]):
        p, q = later[i][0], earlier[j][0]
        if (p, q) != (previous[0] + 1, previous[1] + 1):
            out += block if size >= least_words else []
            block, size = [], 0
        block.append(p)
        size += words[later[i][1]]
        previous = (p, q)
    return out + (block if size >= least_words else [])


def marked(later: list[int], earlier: list[int], words: list[int], least_words: int) -> list[int]:
    """Places of the lines of ``later`` (names; ``words`` of each) that lie in a block which ``earlier`` holds too."""
    size = dict(zip(later, words))
    out = set(common_blocks(list(enumerate(later)), list(enumerate(earlier)), size, least_words))
    if len(out) == len(later):
        return sorted(out)
    # what patience leaves: blocks that recur or stand in another order have no unique anchor, so shortest blocks of both sides are the anchors
    begins, ends = (x.tolist() for x in shortest(np.array(words, dtype=np.int64), np.zeros(len(words), dtype=np.int64), least_words))
    mine, theirs = (Prefix(np.array(x, dtype=np.int64).view(np.uint64)) for x in (later, earlier))
    runs: dict[int, dict[int, int]] = {}  # for each number of lines: name of a run of the earlier document -> its place
    for i, stop in zip(begins, ends):
        if not all(k in out for k in range(i, stop)):
            n = stop - i
            if n not in runs:
                start = np.arange(max(len(earlier) - n + 1, 0))
                runs[n] = dict(zip(theirs.span(start, start + n).tolist(), start.tolist()))
            j = runs[n].get(int(mine.span(np.array([i]), np.array([stop]))[0]))
            j = j if j is not None and earlier[j : j + n] == later[i:stop] else None
            if j is not None:
                while i and j and later[i - 1] == earlier[j - 1]:
                    i, j = i - 1, j - 1
                while i < len(later) and j < len(earlier) and later[i] == earlier[j]:
                    out.add(i)
                    i, j = i + 1, j + 1
    return sorted(out)


def _removed(rows: DataFrame, kind: str, least_words: int) -> DataFrame:
    """Key, tag and the places of the lines that go, as a written table."""
    lines = written(rows.filter("_key is not null").mapInArrow(_lines(least_words), f"_key {kind}, {TAG} long, names array<long>, words array<int>, blocks array<long>"))
    lines = lines.filter("size(blocks) > 0")
    held = written(lines.select("_key", TAG, F.explode("blocks").alias("block")))
    # written before it is joined: a join of two plain shuffles can be split where a block is very frequent
    leads = written(held.groupBy("block").agg(F.min(F.struct("_key", TAG)).alias("lead"), F.max("_key").alias("last")).filter("lead._key < last").select("block", "lead"))
    pairs = held.join(sized(leads), "block").filter("lead._key < _key").select("_key", TAG, F.col("lead._key").alias("_lead"), F.col(f"lead.{TAG}").alias("_lead_tag")).distinct()
    pairs = written(pairs)
    own = written(lines.select("_key", TAG, "names", "words").dropDuplicates(["_key", TAG]))
    theirs = own.select(F.col("_key").alias("_lead"), F.col(TAG).alias("_lead_tag"), F.col("names").alias("earlier"))
    both = pairs.join(shuffled(theirs), ["_lead", "_lead_tag"]).join(shuffled(own), ["_key", TAG]).select("_key", TAG, "names", "words", "earlier")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [marked(a.as_py(), b.as_py(), w.as_py(), least_words) for a, w, b in zip(batch.column(2), batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32()))], names=["_key", TAG, "places"])

    found = both.mapInArrow(align, f"_key {kind}, {TAG} long, places array<int>")
    return written(found.groupBy("_key", TAG).agg(F.collect_set("places").alias("runs")).select("_key", TAG, F.array_distinct(F.flatten("runs")).alias("_gone")))


@F.arrow_udf(T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    lines, removed, kept = [], [], []
    for value, marks in zip(texts, gone):
        text, places = value.as_py(), marks.as_py()
        parts = (text or "").split("\n")
        worded = [bool(p.encode().split()) for p in parts]
        out = set(places or ())
        place, stay = -1, []
        for part, has in zip(parts, worded):
            place += has
            if not (has and place in out):
                stay.append(part)
        lines.append(sum(worded))
        removed.append(len(out))
        kept.append(text if not out else "\n".join(stay))
    return pa.StructArray.from_arrays([pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["n_lines", "n_removed", "kept"])


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` with ``text`` freed of common blocks, and ``n_lines`` (with words, before) and ``n_removed``.

    Lines of any frequency are compared. "Later" means the greater key. Rows with a NULL key, NULL or empty text stay as they are, rows with the same key are not compared
    with each other, repeated rows share their result. A document all of whose lines go keeps its row, with an empty text.
    Columns of ``docs`` called ``n_lines`` or ``n_removed`` are replaced. Empty tables give no rows.
    """
    lean(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.col(key).alias("_key"), row_tag(text).alias(TAG), F.col(text).alias("_text"))
    gone = _removed(rows, docs.schema[key].dataType.simpleString(), least_words)
    release(docs.sparkSession)
    tagged = docs.select(*columns).withColumn("_key", F.col(key)).withColumn(TAG, row_tag(text))
    out = null_safe(tagged, shuffled(gone), ("_key", TAG)).withColumn("_cut", _without(F.col(text), F.col("_gone")))
    return out.select(*[F.col("_cut.kept").alias(c) if c == text else F.col(c) for c in columns], "_cut.n_lines", "_cut.n_removed")


def op5(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], least_words: int = LEAST_WORDS) -> list[tuple[int, int, int, str]]:
    """The same from all pairs of equal lines, each extended as far as both documents agree; for tests. Returns key, lines, removed lines, kept text."""
    split = {k: [(p.encode().split(), p) for p in (t or "").split("\n")] for k, t in texts}
    names = {k: [tuple(w) for w, _ in lines if w] for k, lines in split.items()}
    holders: dict = {}
    result = {}
    for k in sorted(names):
        mine, out = names[k], set()
        for i, x in enumerate(mine):
            for other, j in holders.get(x, ()):
                theirs = names[other]
                if i and j and mine[i - 1] == theirs[j - 1]:
                    continue
                n = 0
                while i + n < len(mine) and j + n < len(theirs) and mine[i + n] == theirs[j + n]:
                    n += 1
                if sum(map(len, mine[i : i + n])) >= least_words:
                    out.update(range(i, i + n))
        for j, x in enumerate(mine):
            holders.setdefault(x, []).append((k, j))
        place, stay = -1, []
        for w, p in split[k]:
            place += bool(w)
            if not (w and place in out):
                stay.append(p)
        result[k] = (k, len(mine), len(out), "\n".join(stay))
    return [(k, *result[k][1:3], result[k][3] if result[k][2] else t or "") for k, t in texts]
