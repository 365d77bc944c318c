"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document with features x is ``b + w.x + sum over pairs <v_i, v_j> x_i x_j``. The pair term is computed in linear time:
per factor it is half of the squared sum of ``v_i x_i`` minus the sum of their squares. Every word occurrence is a feature of value
``WORD_SCALE / words``, every statistic is cut into levels of which one is on.

Training is data-parallel: the labelled sample is dealt to ``WORKERS`` groups, each group makes some passes of Adagrad steps from the
shared parameters, and the driver averages the parameter vectors (a few hundred kilobytes each), for ``ROUNDS`` rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drygrid.llm.common import find_words, lean, mix, pieces, row_tag, written

BUCKETS, FACTORS, WORD_SCALE = 1 << 14, 6, 8.0
SAMPLE, WORKERS, ROUNDS, PASSES, BATCH, RATE, DECAY = 16384, 4, 6, 2, 32, 0.08, 1e-5
LEVELS = 16
THRESHOLD = 0.3

_CLASSES = {"symbols": b"#*$%&<>@^~=_{}[]", "bars": b"|", "calls": b"!?", "digits": b"0123456789", "upper": bytes(range(65, 91)), "breaks": b"\n", "stops": b".,;:"}
STATISTICS = ("length", "word_length", "variety", "repeats", *_CLASSES, "n_chars")
WIDTH = BUCKETS + len(STATISTICS) * LEVELS


def _share(x: np.ndarray) -> np.ndarray:
    """Level of a share between 0 and 1, finer near 0."""
    return np.where(x > 0, np.clip(np.floor(LEVELS - 1 + 2 * np.log2(np.clip(x, 1e-9, 1))), 1, LEVELS - 1), 0).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and first positions of documents; ``n_chars`` is the metadata column, negative if missing."""
    words = find_words(data, offsets)
    n = np.diff(words.first)
    size = np.maximum(np.diff(offsets), 1)
    body = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    per = {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, dtype=np.int64)
        table[list(members)] = 1
        per[name] = np.diff(np.concatenate(([0], np.cumsum(table[body])))[at]) / size
    doc = words.doc
    key = np.sort(mix(words.name ^ mix(doc.astype(np.uint64))))  # the same word of one document: the same key
    order = np.argsort(mix(words.name ^ mix(doc.astype(np.uint64))), kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[1:] = key[1:] == key[:-1]
    repeated = np.bincount(doc[order][again], minlength=len(n))
    pair = mix(words.name[:-1] + mix(words.name[1:])) if len(key) > 1 else np.zeros(0, np.uint64)
    pair_doc = doc[:-1][doc[1:] == doc[:-1]] if len(key) > 1 else np.zeros(0, np.int64)
    pair = mix(pair[doc[1:] == doc[:-1]] ^ mix(pair_doc.astype(np.uint64))) if len(key) > 1 else pair
    order = np.argsort(pair, kind="stable")
    again = np.zeros(len(pair), dtype=bool)
    again[1:] = pair[order][1:] == pair[order][:-1]
    pairs = np.bincount(pair_doc[order][again], minlength=len(n))
    some = np.maximum(n, 1)
    letters = np.bincount(doc, weights=words.stop - words.start, minlength=len(n))
    levels = {
        "length": np.where(n > 0, np.clip(np.floor(np.log2(some)), 0, LEVELS - 2) + 1, 0).astype(np.int64),
        "word_length": np.clip(np.floor(letters / some), 0, LEVELS - 1).astype(np.int64),
        "variety": np.clip(np.floor(repeated / some * (LEVELS - 1)), 0, LEVELS - 1).astype(np.int64),
        "repeats": _share(pairs / some),
        "n_chars": np.where(n_chars >= 0, np.clip(np.floor(np.log2(np.maximum(n_chars, 1))), 0, LEVELS - 2) + 1, 0).astype(np.int64),
    } | {name: _share(x) for name, x in per.items()}
    fixed = np.stack([BUCKETS + k * LEVELS + levels[s] for k, s in enumerate(STATISTICS)], axis=1)
    number = np.concatenate(((words.name >> np.uint64(50)).astype(np.int64), fixed.ravel()))
    value = np.concatenate((np.repeat(WORD_SCALE / some, n), np.ones(fixed.size)))
    row = np.concatenate((doc, np.repeat(np.arange(len(n)), len(STATISTICS))))
    order = np.argsort(row, kind="stable")
    return number[order], value[order], np.concatenate(([0], np.cumsum(n + len(STATISTICS))))


@dataclass
class Machine:
    """Parameters: ``bias``, ``linear`` (WIDTH) and ``factors`` (WIDTH x FACTORS)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 5) -> Machine:
        return cls(0.0, np.zeros(WIDTH), np.random.default_rng(seed).normal(0, 0.02, (WIDTH, FACTORS)))

    @classmethod
    def unpack(cls, data: bytes) -> Machine:
        flat = np.frombuffer(data, dtype=np.float64)
        return cls(float(flat[0]), flat[1 : WIDTH + 1].copy(), flat[WIDTH + 1 :].reshape(WIDTH, FACTORS).copy())

    def pack(self) -> bytes:
        return np.concatenate(([self.bias], self.linear, self.factors.ravel())).tobytes()

    def sums(self, number: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw score and per-factor sums of each row (every row has features)."""
        v = self.factors[number] * value[:, None]
        total = np.add.reduceat(v, first[:-1])
        squares = np.add.reduceat(v * v, first[:-1])
        return self.bias + np.add.reduceat(self.linear[number] * value, first[:-1]) + 0.5 * (total**2 - squares).sum(1), total

    def probability(self, number: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(number, value, first)[0], -30, 30)))

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int) -> None:
        """Passes of mini-batch Adagrad on the log loss."""
        seen_w, seen_v, seen_b = np.full(WIDTH, 1.0), np.full((WIDTH, FACTORS), 1.0), 1.0
        rng = np.random.default_rng(seed)
        order = np.concatenate([rng.permutation(len(rows)) for _ in range(PASSES)])
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            first = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in part])))
            number = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            score, total = self.sums(number, value, first)
            slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[part]) / len(part) * 8
            used, back = np.unique(number, return_inverse=True)
            row = np.repeat(np.arange(len(part)), np.diff(first))
            pull = slope[row] * value
            g_w = np.bincount(back, weights=pull) + DECAY * self.linear[used]
            g_v = np.empty((len(used), FACTORS))
            for f in range(FACTORS):
                g_v[:, f] = np.bincount(back, weights=pull * (total[row, f] - self.factors[number, f] * value))
            g_v += DECAY * self.factors[used]
            seen_w[used] += g_w**2
            seen_v[used] += g_v**2
            seen_b += slope.sum() ** 2
            self.linear[used] -= RATE * g_w / np.sqrt(seen_w[used])
            self.factors[used] -= RATE * g_v / np.sqrt(seen_v[used])
            self.bias -= RATE * slope.sum() / np.sqrt(seen_b)


def _metadata(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)


def _chars(docs: DataFrame, metadata: str):
    return F.col(metadata).cast("double") if metadata in docs.columns else F.lit(None).cast("double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", metadata: str = "n_chars", sample: int = SAMPLE) -> Machine:
    """Learn from at most ``sample`` labelled keys, chosen by hash. Rows of ``labels`` with a NULL key or a label other than 0 and 1 are ignored.

    ``sample`` bounds what is learnt from, never what is scored. Without any usable label the machine scores every document alike.
    """
    lean(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(label).alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most `sample` rows: small enough to broadcast
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), _chars(docs, metadata).alias("_chars"), row_tag(text).alias("_tag"))
    rows = plain.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("_text", "_chars", F.col("_id").cast("string").alias("_id"), "_label", "_tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "_text"):
            number, value, first = features(data, offsets, _metadata(batch, 1))
            numbers = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32)))
            # a row's words come first and weigh the same, its statistics weigh 1
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(4), batch.column(3).cast(pa.int32()), numbers, pa.array(value[first[:-1]])],
                                             names=["id", "tag", "label", "number", "weight"])

    data = rows.mapInArrow(run, "id string, tag long, label int, number array<int>, weight double").dropDuplicates(["id"])
    data = written(data.withColumn("worker", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(WORKERS))))
    machine = Machine.fresh()
    for number in range(ROUNDS):
        start, turn = machine.pack(), number

        def learn(table: pa.Table) -> pa.Table:
            table = table.sort_by([("id", "ascending")])
            own = Machine.unpack(start)
            numbers = [a.values.to_numpy() for a in table.column("number").combine_chunks()]
            values = [np.append(np.full(len(a) - len(STATISTICS), w), np.ones(len(STATISTICS))) for a, w in zip(numbers, table.column("weight").to_pylist())]
            rows_ = list(zip(numbers, values))
            own.learn(rows_, table.column("label").to_numpy().astype(float), turn)
            return pa.table({"n": pa.array([len(rows_)], pa.int64()), "parameters": pa.array([own.pack()], pa.binary())})

        found = data.groupBy("worker").applyInArrow(learn, "n long, parameters binary").collect()
        if found:
            total = sum(r.n for r in found)
            machine = Machine.unpack(sum(np.frombuffer(r.parameters) * (r.n / total) for r in sorted(found, key=lambda r: bytes(r.parameters))).tobytes())
    return machine


def score(docs: DataFrame, machine: Machine, text: str = "text", metadata: str = "n_chars", out: str = "score") -> DataFrame:
    """``docs`` with the probability that the label is 1. NULL and empty texts are scored by their (empty) statistics; repeated rows alike.

    A column ``out`` of ``docs`` is replaced; any other columns pass through. Empty tables give no rows.
    """
    lean(docs.sparkSession)
    columns = [c for c in docs.columns if c != out]
    packed = docs.sparkSession.sparkContext.broadcast(machine.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine.unpack(packed.value)
        for batch, data, offsets in pieces(batches, text):
            found = own.probability(*features(data, offsets, _metadata(batch, batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(found)], names=[*columns, out])

    schema = docs.select(*columns).schema.add(out, "double")
    return docs.select(*columns, _chars(docs, metadata).alias("_chars")).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Whether a document is left out of learning: crc32 of its key as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``, learnt from labels outside the held-out fifth."""
    return score(docs, fit(docs, labels.filter(~held_out())))


def op1(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "n_chars")
    scored = quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
