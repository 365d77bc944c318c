"""Words, batches and written tables shared by the text operators.

Words are found and hashed on the bytes of whole Arrow batches, so no operator loops over single words in Python. A word is a
run of bytes other than space and the control bytes 9 to 13, the same in UTF-8 as in code points.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text handled at once inside a task; a longer document is handled alone, word by word in pieces of this size.
PIECE = (1 << 20) - 1
BATCH_ROWS = 1000
FEW = 1 << 16  # rows of a counted table that is broadcast
TAG = "_row_tag"
_BATCH_LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROOT = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply-and-shift steps)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


class _Powers:
    """Powers of the root and of its inverse, grown on demand and kept per worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, root in (("up", _ROOT), ("down", _ROOT_INVERSE)):
                steps = np.full(size, root, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


class Prefix:
    """Prefix sums of a value sequence; :meth:`span` hashes any span of it, equal for equal contents."""

    def __init__(self, values: np.ndarray) -> None:
        up, self._down = _powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self._sums[stop] - self._sums[start]) * self._down[start]
        return mix(raw ^ (np.asarray(stop - start, dtype=np.uint64) << np.uint64(40)))


@dataclass
class Words:
    """Words of several documents in one sequence: document ``d`` has the words ``first[d]`` to ``first[d + 1]``."""

    start: np.ndarray  # byte positions
    stop: np.ndarray
    name: np.ndarray  # 64-bit hash of each word
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents that ``offsets`` cuts from the bytes ``data``."""
    codes = _CODES[_LOWER] if lower else _CODES
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop, width = min(end, at + PIECE), PIECE
        while stop < end and not _SPACE[data[stop - 1]]:  # cut after white space only
            back = np.flatnonzero(_SPACE[data[at:stop]])
            if len(back):
                stop = at + int(back[-1]) + 1
            else:
                width *= 2
                stop = min(end, at + width)
        piece = data[at:stop]
        solid = ~_SPACE[piece]
        edge = np.zeros(len(piece) + 1, dtype=bool)
        inner = offsets[(offsets >= at) & (offsets <= stop)] - at
        edge[inner] = True
        edge[0] = edge[-1] = True
        before = np.concatenate(([False], solid))
        after = np.concatenate((solid, [False]))
        begins = np.flatnonzero(after & (edge | ~before))
        ends = np.flatnonzero(before & (edge | ~after))
        parts.append((begins + at, ends + at, Prefix(codes[piece]).span(begins, ends)))
        at = stop
    if parts:
        start, stop_, name = (np.concatenate([p[i] for p in parts]) for i in range(3))
    else:
        start, stop_, name = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return Words(start, stop_, name, np.searchsorted(start, offsets).astype(np.int64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; NULL counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of about ``PIECE`` bytes of text: the rows, their bytes and their offsets.

    A batch is let go of before the next one is read, so a worker holds one at a time.
    """
    for batch in batches:
        if batch.num_rows:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
                yield batch.slice(row, stop - row), data, offsets[row : stop + 1]
                row = stop
            del data, offsets
        del batch


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``size`` words; a document with fewer words gives its whole sequence, an empty one nothing."""
    prefix, count = Prefix(words.name), np.diff(words.first)
    number = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    doc = np.repeat(np.arange(len(number)), number)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + words.first[doc]
    return prefix.span(start, np.minimum(start + size, words.first[doc + 1])), doc


def distinct_per_document(values: np.ndarray, doc: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document and the position where each document's values begin."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, np.searchsorted(doc, np.arange(documents + 1))


def lists(values: pa.Array, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


# --- tables ------------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``; only a local session without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and lost executors lose nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(spark: SparkSession) -> None:
    """Send texts to the workers ``BATCH_ROWS`` at a time, not Spark's default of 10,000, so batches stay small beside the heap.

    A session that sets the number itself keeps its own. Results don't depend on it.
    """
    if spark.conf.get(_BATCH_LIMIT) == "10000":
        spark.conf.set(_BATCH_LIMIT, str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps; it acts when the driver collects its garbage.

    The first pass finds the tables that Python has let go of, the second the shuffles that only they held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def row_tag(text: Column | str = "text") -> Column:
    """With the id, names a row by its content: rows alike in id and text share every result."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(17))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles and sorts, whatever its size seems to be.

    The planner takes a table for as large as its compressed files, and an explode for no larger than what it expands; a table that it
    broadcasts for that reason can take many times as much on the driver. Tables that grow with the corpus are joined so.
    """
    return df.hint("merge")


def sized(df: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """``df``, rows of bounded width, as a side of a join: broadcast if it has up to ``FEW`` rows, else :func:`shuffled`.

    Counted is ``within``, a written table with no fewer rows (``df`` itself unless given).
    """
    return F.broadcast(df) if (df if within is None else within).limit(FEW + 1).count() <= FEW else shuffled(df)


def null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the right side's keys are dropped."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for key in keys:
        same = left[key].eqNullSafe(right[f"_r_{key}"])
        on = same if on is None else on & same
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])
