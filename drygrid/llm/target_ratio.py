"""Quality rules with a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed to slots, whose number grows with the square root of the corpus, about as its vocabulary does. Two
multinomials over the slots are counted: one over the whole corpus, one over all trusted documents. A document's score is the mean over its n-grams of ``log(trusted / corpus)``, less the corpus's own mean (its divergence from
the trusted distribution), so the same limit suits corpora of any size and mixture. Every document scoring at least ``LIMIT`` passes,
without random draws. Simple base rules reject before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drygrid.llm.common import Prefix, Words, find_words, lean, mix, pieces, written

SLOTS = 1 << 17  # half for words, half for pairs; for up to SLOT_DOCS documents
SLOT_DOCS = 1 << 16
MOST_SLOTS = 1 << 22  # a worker holds a table of 32 MB at most; beyond 67 million documents rare n-grams share slots more often
KEY_BITS, KEY_HASHES = 1 << 25, 3  # filter of trusted keys, 4 MB; beyond 5 million keys more texts than the trusted ones move
PRIOR = 0.1  # share of the corpus distribution mixed into the trusted one, against slots that no trusted document has
LIMIT = -0.35
WINDOW = 8
_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_LEADS = (np.arange(256) & 0xC0) != 0x80


def slot_count(documents: int) -> int:
    """``SLOTS``, doubled with every fourfold of ``SLOT_DOCS``, up to ``MOST_SLOTS``."""
    size = SLOTS
    while size < MOST_SLOTS and documents > SLOT_DOCS * (size // SLOTS) ** 2:
        size *= 2
    return size


def slots(words: Words, size: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Slot (of ``size``, a power of two) and document of every word and every pair of neighbours."""
    doc, half = words.doc, size // 2
    shift = np.uint64(65 - half.bit_length())
    one = (words.name >> shift).astype(np.int64)
    joined = doc[1:] == doc[:-1]
    two = half + (mix(words.name[:-1] + mix(words.name[1:] ^ np.uint64(3)))[joined] >> shift).astype(np.int64)
    return np.concatenate((one, two)), np.concatenate((doc, doc[1:][joined]))


def trusted_keys(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """All keys labelled 1, each once."""
    return labels.filter((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("_id")).distinct()


def _key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``_id`` as bytes; what comes to the driver is as large as the filter."""
    spots = F.explode(F.array(*[F.pmod(F.xxhash64("_id", F.lit(k)), F.lit(KEY_BITS)) for k in range(KEY_HASHES)])).alias("spot")
    words = keys.select(spots).groupBy((F.col("spot") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(KEY_BITS // 64, dtype=np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits


def _trusted_texts(docs: DataFrame, trusted: DataFrame, text: str, key: str) -> DataFrame:
    """The texts of the rows with a trusted key. Only rows that pass a filter of these keys are shuffled; a merge join then tells exactly, at every size."""
    bits = docs.sparkSession.sparkContext.broadcast(_key_filter(trusted))

    @F.arrow_udf("boolean")
    def listed(*spots: pa.Array) -> pa.Array:
        found = True
        for spot in (x.to_numpy(zero_copy_only=False) for x in spots):
            found = found & ((bits.value[spot >> 6] >> (spot & 63)) & 1 > 0)
        return pa.array(found)

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    some = rows.filter(listed(*[F.pmod(F.xxhash64("_key", F.lit(k)), F.lit(KEY_BITS)) for k in range(KEY_HASHES)]))
    return some.join(trusted.hint("merge"), F.col("_key") == F.col("_id"), "left_semi").select("_text")


def _slot_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often each slot comes in the column ``_text``; counted inside the tasks, added up by a shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, dtype=np.int64)
        for _, data, offsets in pieces(batches, "_text"):
            found += np.bincount(slots(find_words(data, offsets), size)[0], minlength=size)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["slot", "n"])

    table = texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most size rows
    out = np.zeros(size, dtype=np.int64)
    out[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return out


def log_ratio(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """Centred log ratio of every slot (:func:`slot_count` numbers) from counts over all of ``docs``; ``trusted`` (``_id``) has distinct keys."""
    lean(docs.sparkSession)
    size = slot_count(docs.count())
    # written before it is joined: a join of two plain shuffles can be split where a key is very frequent
    good = _slot_counts(_trusted_texts(docs, written(trusted), text, key), size).astype(float)
    raw = _slot_counts(docs.select(F.col(text).alias("_text")), size) + 0.5
    share = raw / raw.sum()
    if not good.sum():
        return np.zeros(size)  # nothing to compare with: all scores are 0
    ratio = np.log((good / good.sum() + PRIOR * share) / (1 + PRIOR) / share)
    return ratio - (share * ratio).sum()


def measures(words: Words, data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and the score of each document of a piece."""
    n = np.diff(words.first)
    at = offsets - offsets[0]
    body = data[offsets[0] : offsets[-1]]
    leads = np.concatenate(([0], np.cumsum(_LEADS[body])))
    doc = words.doc
    chars = np.bincount(doc, weights=leads[words.stop - offsets[0]] - leads[words.start - offsets[0]], minlength=len(n)).astype(np.int64)
    symbols = np.diff(np.concatenate(([0], np.cumsum(_SYMBOLS[body])))[at])

    number = np.maximum(n - WINDOW + 1, 0)
    window_doc = np.repeat(np.arange(len(n)), number)
    start = np.arange(len(window_doc)) - np.repeat(np.cumsum(number) - number, number) + words.first[window_doc]
    name = mix(Prefix(words.name).span(start, start + WINDOW) ^ mix(window_doc.astype(np.uint64)))
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    twice = np.zeros(len(name), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words.name) + WINDOW + 1, dtype=np.int64)
    np.add.at(steps, start[twice], 1)
    np.add.at(steps, start[twice] + WINDOW, -1)
    covered = np.cumsum(steps)[: len(words.name)] > 0
    repeat = np.bincount(doc[covered], minlength=len(n))

    lines = np.zeros(len(n), dtype=np.int64)
    for d in range(len(n)):
        seen, again = set(), 0
        for line in data[offsets[d] : offsets[d + 1]].tobytes().split(b"\n"):
            if line in seen:
                again += not (line.isspace() or not line)
            else:
                seen.add(line)
        lines[d] = again
    slot, slot_doc = slots(words, len(ratio))
    grams = np.bincount(slot_doc, minlength=len(n))
    score = np.bincount(slot_doc, weights=ratio[slot], minlength=len(n)) / np.maximum(grams, 1)
    failed = (n < 20) | (100 * repeat > 30 * n)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeat, "base_failed": failed, "score": score}


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def judged(docs: DataFrame, ratio: np.ndarray, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """``docs`` with the base counts, ``score`` and ``kept``.

    NULL and empty texts have no words, score 0 and fail the base rules. Repeated rows get the same result. Columns of ``docs`` with
    the names of added ones are replaced; empty tables give no rows.
    """
    lean(docs.sparkSession)
    columns = [c for c in docs.columns if c not in MEASURES]
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, text):
            found = measures(find_words(data, offsets), data, offsets, table.value)
            found["kept"] = ~found["base_failed"] & (found["score"] >= limit)
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(found[m]) for m in MEASURES]], names=[*columns, *MEASURES])

    schema = docs.select(*columns).schema
    for name in MEASURES:
        schema = schema.add(name, "boolean" if name in ("base_failed", "kept") else "double" if name == "score" else "long")
    return docs.select(*columns).mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", limit: float = LIMIT) -> DataFrame:
    """Judge every row of ``docs`` against the trusted documents of ``labels``. See :func:`judged`."""
    return judged(docs, log_ratio(docs, trusted_keys(labels, key), text, key), text, limit)


def op7(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = quality_rules(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """Base counts of one text; for tests."""
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        windows.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    covered = {j for starts in windows.values() if len(starts) > 1 for i in starts for j in range(i, i + WINDOW)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        again += bool(re.search("[^\x20\x09-\x0d]", line)) and line in seen
        seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), again, len(covered), n < 20 or 100 * len(covered) > 30 * n
