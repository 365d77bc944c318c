"""Corpus-wide values for the entries of chunks.

A chunk is a run of documents with about ``CHUNK`` bytes of text. Its row holds a dictionary (its distinct entries, each with a number),
and what each document has of it, by place in the dictionary. Numbers are added up over the corpus by a shuffle on the entry; the value of
each entry goes back to the chunks that asked, and a chunk meets its answers in one group. So an entry travels once for each chunk that
has it, not once for each document, nothing is broadcast that grows with the corpus, and a group is no larger than a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from drygrid.llm.common import shuffled, written

CHUNK = 1 << 24
FIELDS = ["chunk", "keys", "marks", "entries", "numbers", "first", "places", "times"]


def fields(kind: str, entry: str, mark: str) -> str:
    """Schema of a table of chunks: the key of each document, ``marks`` of it, dictionary, and its places with how often each comes."""
    return f"chunk long, keys array<{kind}>, marks array<{mark}>, entries array<{entry}>, numbers array<long>, first binary, places binary, times binary"


def squeeze(values: np.ndarray) -> bytes:
    """32-bit numbers in four byte planes, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def tally(doc: np.ndarray, entry: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries (below 2**31) of each document and how often each comes: first positions, entries, times."""
    both, times = np.unique((doc.astype(np.int64) << 31) | entry, return_counts=True)
    return np.searchsorted(both >> 31, np.arange(documents + 1)), (both & ((1 << 31) - 1)).astype(np.int32), times.astype(np.int32)


@dataclass
class Part:
    """Some documents of a chunk: keys, marks, their own dictionary and its numbers, and what each has of it."""

    keys: pa.Array
    marks: pa.Array
    entries: list | np.ndarray
    names: np.ndarray  # 64-bit names of the entries
    numbers: np.ndarray
    first: np.ndarray
    places: np.ndarray
    times: np.ndarray


def chunked(parts: Iterator[tuple[int, Part]], entry: pa.DataType, mark: pa.DataType, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of chunks from parts, each with its bytes of text."""
    held: list[Part] = []
    weight = number = 0

    def flush() -> pa.RecordBatch:
        names = np.concatenate([p.names for p in held])
        _, at, to = np.unique(names, return_index=True, return_inverse=True)
        numbers = np.bincount(to, weights=np.concatenate([p.numbers for p in held]), minlength=len(at)).astype(np.int64)
        if isinstance(held[0].entries, np.ndarray):
            entries = np.concatenate([p.entries for p in held])[at]
        else:
            every = [e for p in held for e in p.entries]
            entries = [every[i] for i in at.tolist()]
        shift = np.cumsum([0, *[len(p.names) for p in held]])
        places = np.concatenate([to[p.places + s] for p, s in zip(held, shift)])
        times = np.concatenate([p.times for p in held])
        counts = np.concatenate([np.diff(p.first) for p in held])
        keys, marks = (pa.concat_arrays([getattr(p, n) for p in held]) for n in ("keys", "marks"))
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([
            pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()), whole(keys), whole(marks.cast(mark)), whole(pa.array(entries, entry)), whole(pa.array(numbers)),
            pa.array([squeeze(counts)], pa.binary()), pa.array([squeeze(places)], pa.binary()), pa.array([squeeze(times)], pa.binary())], names=FIELDS)

    for bytes_, part in parts:
        held.append(part)
        weight += bytes_
        if weight >= (size or CHUNK):
            yield flush()
            held, weight, number = [], 0, number + 1
    if held:
        yield flush()


def asked(chunks: DataFrame) -> DataFrame:
    """Rows ``chunk``, ``place``, ``entry``, ``n``: all entries of all dictionaries."""
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("entries", "numbers")).alias("place", "_x"))
    return listed.select("chunk", "place", F.col("_x.entries").alias("entry"), F.col("_x.numbers").alias("n"))


def totals(chunks: DataFrame) -> DataFrame:
    """Rows ``entry``, ``n``: each entry's numbers added up over the corpus, as a written table."""
    return written(asked(chunks).groupBy("entry").agg(F.sum("n").alias("n")))


def answered(chunks: DataFrame, values: DataFrame, judge: Callable, schema: str) -> DataFrame:
    """The rows that ``judge`` makes of each chunk. ``values`` has one row for each entry.

    ``judge(keys, marks, document, place, times, table)`` gets the documents' keys and marks, for each entry of a document its number,
    place and times, and the columns of ``values`` in the order of places; it returns a table with ``schema``.
    """
    answers = asked(chunks).select(F.col("chunk").alias("_of"), "place", "entry").join(shuffled(values), "entry").drop("entry")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.column_names}
        right = right.sort_by("place")
        count, places, times = (unsqueeze(row[c].as_py()) for c in ("first", "places", "times"))
        return judge(row["keys"].values, row["marks"].values, np.repeat(np.arange(len(count)), count), places, times, right)

    bodies = chunks.select("chunk", "keys", "marks", "first", "places", "times")
    return bodies.groupBy("chunk").cogroup(answers.groupBy("_of")).applyInArrow(run, schema)
