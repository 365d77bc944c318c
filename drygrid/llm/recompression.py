"""Substring de-duplication by recompression.

Rounds rename the word sequence: a run of one symbol becomes a symbol, then pairs whose left part falls on one side and right part
on the other side of a split of the alphabet become symbols. A name is a hash of the parts it stands for, so names are global
without a dictionary: every task gives equal content the same name. Whether a symbol arises depends only on the words of its
*support* (itself and the neighbours that were looked at), so equal passages hold equal symbols wherever the support lies inside.

* Every window of words stands for the highest symbol whose support lies inside it (least hash, then leftmost). Equal windows have
  equal symbols, so only windows with a symbol that occurs twice can repeat. This leaves few windows.
* A symbol of the last round and as many followers as hold every window that starts in it form a stretch. A stretch whose content
  occurs twice is a repeat as a whole, and
  its windows need no check of their own. Only the row with the least tag still reports those of them whose symbol occurs more
  often than the stretch, for the sake of passages that overlap the stretch in part.
* The remaining windows are counted by the hash of all their words. This is the exact verification.

Documents are independent in every round, so rounds run inside the tasks; Spark shuffles symbols, never all windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drygrid.llm.common import TAG, Prefix, Words, find_words, lean, mix, null_safe, pieces, release, row_tag, written

WINDOW = 35
LEVELS = 3  # rounds whose symbols stand for windows
ROUNDS = 13  # rounds until symbols cover long stretches
_STRETCH = np.uint64(0x5BF03635DCF1A1C3)


class Symbols:
    """Symbols of one round over a word sequence: word span, support and document of each."""

    def __init__(self, name, start, stop, low, high, doc) -> None:
        self.name, self.start, self.stop, self.low, self.high, self.doc = name, start, stop, low, high, doc

    @classmethod
    def words(cls, words: Words) -> Symbols:
        at = np.arange(len(words.name), dtype=np.int64)
        return cls(words.name, at, at + 1, at, at + 1, words.doc)

    def neighbours(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the next symbol is in the same document; lower support of the one before, upper of the one after."""
        joined = np.zeros(len(self.name), dtype=bool)
        joined[:-1] = self.doc[1:] == self.doc[:-1]
        before, after = first[self.doc] - 1, first[self.doc + 1] + 1  # beyond the document: outside every window
        before[1:] = np.where(joined[:-1], self.low[:-1], before[1:])
        after[:-1] = np.where(joined[:-1], self.high[1:], after[:-1])
        return joined, before, after

    def runs(self, first: np.ndarray) -> Symbols:
        joined, before, after = self.neighbours(first)
        head = np.ones(len(self.name), dtype=bool)
        head[1:] = ~joined[:-1] | (self.name[1:] != self.name[:-1])
        begin = np.flatnonzero(head)
        last = np.append(begin[1:], len(self.name)) - 1
        length = (last - begin + 1).astype(np.uint64)
        name = np.where(length == 1, self.name[begin], mix(self.name[begin] + mix(length)))
        return Symbols(name, self.start[begin], self.stop[last], before[begin], after[last], self.doc[begin])

    def pairs(self, first: np.ndarray, number: int) -> Symbols:
        joined, before, after = self.neighbours(first)
        left = mix(self.name ^ np.uint64(number * 0x9E37 + 1)) >> np.uint64(63) == 0
        open_ = np.zeros(len(self.name), dtype=bool)
        open_[:-1] = joined[:-1] & left[:-1] & ~left[1:]
        head = np.ones(len(self.name), dtype=bool)
        head[1:] = ~open_[:-1]
        i = np.flatnonzero(head)
        pair = open_[i]
        j = i + pair
        name = np.where(pair, mix(self.name[i] * np.uint64(3) + mix(self.name[j])), self.name[i])
        low = np.where(pair | left[i], self.low[i], before[i])
        high = np.where(pair | ~left[i], self.high[j], after[i])
        return Symbols(name, self.start[i], self.stop[j], low, high, self.doc[i])


class Parse:
    """The rounds over one piece: ``anchor`` per window start, anchors' names, stretches and their names."""

    def __init__(self, words: Words, window: int) -> None:
        self.first, self.window = words.first, window
        self.prefix = Prefix(words.name)
        count = np.diff(words.first)
        number = np.maximum(count - window + 1, 0)
        doc = np.repeat(np.arange(len(number)), number)
        self.at = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + words.first[doc]
        self.at_doc = doc
        symbols, levels = Symbols.words(words), []
        levels.append(symbols)
        for k in range(ROUNDS):
            if not len(symbols.name):
                break
            if k < 3:
                symbols = symbols.runs(words.first)
            symbols = symbols.pairs(words.first, k)
            if k < LEVELS:
                levels.append(symbols)
        self._choose(levels)
        self._stretches(symbols)

    def _choose(self, levels: list[Symbols]) -> None:
        """For every window the highest level with a symbol inside it; there the symbol of least hash, the leftmost of equals."""
        self.anchor = np.full(len(self.at), -1, dtype=np.int64)
        names, docs, base = [], [], 0
        todo = np.arange(len(self.at))
        for level in reversed(levels):
            if not len(todo):
                break
            s = self.at[todo]
            i = np.searchsorted(level.low, s, side="left")
            j = np.searchsorted(level.high, s + self.window, side="right")
            has = j > i
            content = self.prefix.span(np.maximum(level.low, 0), np.minimum(level.high, self.first[-1]))
            chosen = _least(content, i[has], j[has])
            used, back = np.unique(chosen, return_inverse=True)
            self.anchor[todo[has]] = back + base
            names.append(content[used])
            docs.append(level.doc[used])
            base += len(used)
            todo = todo[~has]
        self.name = np.concatenate(names) if names else np.zeros(0, np.uint64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)

    def _stretches(self, top: Symbols) -> None:
        """From each symbol of the last round as many symbols on as hold every window that starts in it, or to the document's end."""
        n = len(top.name)
        i = np.arange(n)
        last = np.searchsorted(top.doc, top.doc, side="right") - 1
        j = np.minimum(np.searchsorted(top.stop, top.stop + self.window - 1), last)
        keep = top.stop[j] - top.start[i] >= self.window
        i, j = i[keep], j[keep]
        self.s_start, self.s_stop, self.s_doc = top.start[i], top.stop[j], top.doc[i]
        self.s_name = self.prefix.span(self.s_start, self.s_stop) ^ _STRETCH


def _least(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Index of the least value in each range ``i`` to ``j`` (not empty), the leftmost of equals."""
    if not len(i):
        return np.zeros(0, np.int64)
    width = j - i
    out = np.empty(len(i), dtype=np.int64)
    best, size = np.arange(len(values), dtype=np.int64), 1
    while True:
        here = (width >= size) & (width < 2 * size)
        if here.any():
            a, b = best[i[here]], best[j[here] - size]
            out[here] = np.where(values[b] < values[a], b, a)
        if size * 2 > width.max():
            return out
        a, b = best[:-size] if size < len(best) else best, best[size:]
        best = np.where(values[b] < values[a[: len(b)]], b, a[: len(b)])
        size *= 2


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Remove every word covered by a run of ``window`` words that starts anywhere else too, same document included.

    Adds ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space) to the rows of ``docs``. Repeats are judged
    on the input, so all copies of a passage lose it. NULL or empty text: no words, nothing removed, ``kept_text`` empty. Rows
    alike in key and text share their result and count as repeats of each other. Empty tables give no rows. Columns of ``docs``
    with the same names as those added are replaced.
    """
    lean(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), row_tag(text).alias(TAG), F.col(text).alias("_text"))
    spans = _spans(rows, docs.schema[key].dataType.simpleString(), window)
    release(docs.sparkSession)
    asked = spans.filter("counted")
    twice = written(asked.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    repeated = asked.select("_key", TAG, "hash", "begin").join(twice, "hash")
    covered = written(
        repeated.select("_key", TAG, "begin", (F.col("begin") + window).alias("end")).unionByName(spans.filter("not counted").select("_key", TAG, "begin", "end"))
        .groupBy("_key", TAG).agg(F.collect_set(F.struct("begin", "end")).alias("_spans"))
    )
    kept = docs.drop("n_words", "n_removed", "kept_text").withColumn("_key", F.col(key)).withColumn(TAG, row_tag(text))
    out = null_safe(kept, covered, ("_key", TAG)).drop("_key", TAG)
    return out.select(*[c for c in out.columns if c != "_spans"], _cut(F.col(text), F.col("_spans")).alias("_cut")).select(
        *[c for c in out.columns if c != "_spans"], "_cut.*")


def _pair(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(name ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def _spans(rows: DataFrame, key_type: str, window: int) -> DataFrame:
    """Spans of shared stretches (``counted`` false) and windows left to count (with their hash), as a written table."""

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, data, offsets in pieces(batches, "_text"):
            parse = Parse(find_words(data, offsets), window)
            doc = pa.array(np.concatenate((parse.doc, parse.s_doc)))
            name = np.concatenate((parse.name, parse.s_name))
            yield pa.RecordBatch.from_arrays([rows_.column(0).take(doc), pa.array(_signed(name))], names=[TAG, "name"])

    # a tag shared by two texts would only add names here; spans below name their rows by key and tag
    found = written(rows.select(TAG, "_text").mapInArrow(symbols, f"{TAG} long, name long"))
    # counts are written before they are joined: a join of two plain shuffles can be split where a name is very frequent
    twice = written(found.groupBy("name").agg(F.count("*").alias("n"), F.min(TAG).alias("owner")).filter("n > 1"))
    # written as well: texts are joined by tag, and a third of them may be the same
    shared = written(
        found.join(twice, "name").select(TAG, F.struct("name", "n", (F.col(TAG) == F.col("owner")).alias("own")).alias("s"))
        .groupBy(TAG).agg(F.collect_set("s").alias("names"))
    )
    release(rows.sparkSession)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, data, offsets in pieces(batches, "_text"):
            parse = Parse(find_words(data, offsets), window)
            names = rows_.column(3)
            row = np.repeat(np.arange(len(names)), names.value_lengths().to_numpy(zero_copy_only=False))
            name, n, own = (names.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("name", "n", "own"))
            known = _Known(_pair(name.astype(np.int64).view(np.uint64), row), n, own)
            s_n, s_own = known(_pair(parse.s_name, parse.s_doc))
            a_n, _ = known(_pair(parse.name, parse.doc))
            w_n = a_n[parse.anchor] if len(parse.at) else np.zeros(0, np.int64)
            held = s_n > 0
            start, stop = parse.s_start[held], parse.s_stop[held]
            reach = np.zeros(len(parse.at), dtype=np.int64)  # most occurrences of a shared stretch around the window
            ours = np.zeros(len(parse.at), dtype=bool)  # whether this row is the one that reports such a stretch
            i, j = np.searchsorted(parse.at, start), np.searchsorted(parse.at, stop - window, side="right")
            for first, last, count, mine in zip(i.tolist(), j.tolist(), s_n[held].tolist(), s_own[held].tolist()):
                np.maximum(reach[first:last], count, out=reach[first:last])
                if mine:
                    ours[first:last] = True
            ask = np.flatnonzero((w_n > 0) & ((reach == 0) | (ours & (w_n > reach))))
            at, doc, s_doc = parse.at[ask], parse.at_doc[ask], parse.s_doc[held]
            doc_all = pa.array(np.concatenate((doc, s_doc)))
            begin = np.concatenate((at - parse.first[doc], start - parse.first[s_doc])).astype(np.int32)
            end = np.concatenate((at - parse.first[doc] + window, stop - parse.first[s_doc])).astype(np.int32)
            hashes = np.concatenate((_signed(parse.prefix.span(at, at + window)), np.zeros(len(start), np.int64)))
            yield pa.RecordBatch.from_arrays(
                [rows_.column(0).take(doc_all), rows_.column(1).take(doc_all), pa.array(hashes), pa.array(np.arange(len(begin)) < len(ask)), pa.array(begin), pa.array(end)],
                names=["_key", TAG, "hash", "counted", "begin", "end"])

    held = rows.join(shared, TAG).select("_key", TAG, "_text", "names")
    return written(held.mapInArrow(windows, f"_key {key_type}, {TAG} long, hash long, counted boolean, begin int, end int"))


class _Known:
    """Lookup of a row's shared names: occurrences (0 if not shared) and whether the row reports them."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, own: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.n, self.own = keys[order], n[order].astype(np.int64), own[order].astype(bool)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.n[at], 0), hit & self.own[at]


def _cut(text, spans):
    """Struct of word count, removed words and kept text."""
    @F.arrow_udf("struct<n_words:long,n_removed:long,kept_text:string>")
    def cut(texts: pa.Array, marks: pa.Array) -> pa.Array:
        counts, removed, kept = [], [], []
        for value, mark in zip(texts, marks):
            words = (value.as_py() or "").encode().split()
            counts.append(len(words))
            if mark.is_valid:
                steps = np.zeros(len(words) + 1, dtype=np.int64)
                flat = mark.values
                np.add.at(steps, flat.field("begin").to_numpy(), 1)
                np.add.at(steps, flat.field("end").to_numpy(), -1)
                stay = np.cumsum(steps)[:-1] == 0
                words = [w for w, k in zip(words, stay.tolist()) if k]
            removed.append(counts[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept_text"])
    return cut(text, spans)


def op8(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same by counting all windows in one dictionary; for tests."""
    split = [(k, (t or "").encode().split()) for k, t in texts]
    seen: dict[tuple, int] = {}
    for _, words in split:
        for i in range(len(words) - window + 1):
            seen[tuple(words[i : i + window])] = seen.get(tuple(words[i : i + window]), 0) + 1
    out = []
    for k, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        left = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((k, len(words), sum(gone), hashlib.sha256(left).hexdigest()))
    return out
