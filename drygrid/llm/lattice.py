"""Scores of whole texts by the subword lattice: the probability of a text summed over all its segmentations.

An existing vocabulary with a score for each piece spans a lattice over the bytes of a word (behind a space): each path from its begin to its
end is a segmentation, weighed by the product of its pieces' probabilities. A forward recursion in log space adds up all paths; no best
path is chosen. As no piece has a space behind its first byte, the lattice of a text is the chain of its words' lattices, so its
marginal probability is the product over its words, times that of the end.

The scores of the vocabulary are ranks; by Zipf's law they give the first probabilities, which stay in as a prior. They are fitted to the
training documents by expected counts (forward times backward) over all their distinct words, weighed by how often each occurs, ``ROUNDS`` times.

Words are counted through chunk dictionaries (:mod:`drygrid.llm.exchange`): each distinct word of the corpus runs through the lattice once,
and its count and marginal go back to the chunks that have it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from drygrid.llm.common import find_words, lean, pieces, written
from drygrid.llm.exchange import Part, answered, chunked, fields, tally, totals

ROUNDS = 2
PRIOR = 1000.0  # expected pieces that the vocabulary's own scores count for
CELLS = 1 << 21  # bytes of words that go through lattices at once
FOLDS, LEFT_OUT = 7, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def vocabulary(path: str | None = None) -> dict[bytes, float]:
    """First probabilities of the pieces (bytes; a space for the word mark) of a ``sentencepiece`` model; scores are taken as negative ranks.

    Byte pieces, which have no rank, get the weight of the last one, and add to a piece of the same bytes. Control pieces are left out.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    last = max((-model.get_score(i) for i in ids if not model.is_byte(i)), default=0.0)
    out: dict[bytes, float] = {}
    for i in ids:
        piece = bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        out[piece] = out.get(piece, 0.0) + 1 / (1 + (last if model.is_byte(i) else max(0.0, -model.get_score(i))))
    total = sum(out.values())
    return {piece: weight / total for piece, weight in out.items()}


@dataclass
class Lattice:
    """A vocabulary as a tree of bytes: ``edges`` (node * 256 + byte, sorted) lead to ``targets``; ``piece`` is a node's piece, or -1."""

    edges: np.ndarray
    targets: np.ndarray
    piece: np.ndarray
    log: np.ndarray  # log probability of each piece

    @classmethod
    def of(cls, weights: dict[bytes, float]) -> Lattice:
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        for number, piece in enumerate(weights):
            node = 0
            for byte in piece:
                node = steps.setdefault(node * 256 + byte, len(steps) + 1)
            ends[node] = number
        edges = np.array(sorted(steps), dtype=np.int64)
        of = np.full(len(steps) + 1, -1, dtype=np.int64)
        of[list(ends)] = list(ends.values())
        return cls(edges, np.array([steps[e] for e in edges.tolist()], dtype=np.int64), of, np.log(np.fromiter(weights.values(), float)))

    def matches(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Pieces in words of one length (rows of bytes): begin, end, rows and piece numbers, by begin."""
        out = []
        for begin in range(words.shape[1]):
            row, node = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
            for end in range(begin + 1, words.shape[1] + 1):
                wanted = node * 256 + words[row, end - 1]
                at = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
                found = self.edges[at] == wanted
                row, node = row[found], self.targets[at[found]]
                if not len(row):
                    break
                piece = self.piece[node]
                ends = piece >= 0
                if ends.any():
                    out.append((begin, end, row[ends], piece[ends]))
        return out

    def forward(self, words: np.ndarray, matches: list) -> np.ndarray:
        """Log of the summed weights of all paths to each byte position (rows x length + 1)."""
        total = np.full((words.shape[1] + 1, len(words)), -np.inf)
        total[0] = 0
        for begin, end, row, piece in matches:  # all that ends at `begin` has come before
            total[end, row] = np.logaddexp(total[end, row], total[begin, row] + self.log[piece])
        return total.T

    def expected(self, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations of the words, weighed."""
        matches = self.matches(words)
        ahead = self.forward(words, matches).T
        back = np.full_like(ahead, -np.inf)
        back[-1] = 0
        out = np.zeros(len(self.log))
        for begin, end, row, piece in reversed(matches):
            rest = self.log[piece] + back[end, row]
            back[begin, row] = np.logaddexp(back[begin, row], rest)
            with np.errstate(invalid="ignore"):
                out += np.bincount(piece, weights=np.nan_to_num(np.exp(ahead[begin, row] + rest - ahead[-1, row])) * weight[row], minlength=len(out))
        return out

    def marginal(self, words: np.ndarray) -> np.ndarray:
        return self.forward(words, self.matches(words))[:, -1]


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and bytes (behind a space) of words of one length, ``CELLS`` bytes at most unless one word is longer."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    length = np.diff(offsets)
    order = np.argsort(length, kind="stable")
    edge = np.flatnonzero(np.diff(length[order], prepend=-1))
    for a, b in zip(edge, np.append(edge[1:], len(order))):
        size = int(length[order[a]])
        step = max(1, CELLS // (size + 1))
        for c in range(a, b, step):
            rows = order[c : min(b, c + step)]
            block = np.full((len(rows), size + 1), 32, dtype=np.uint8)
            block[:, 1:] = data[offsets[rows][:, None] + np.arange(size)]
            yield rows, block.astype(np.int64)


def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to about ``CELLS`` bytes, so that many words of each length go through a lattice at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= CELLS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@dataclass
class Model:
    """What is learnt: ``training`` tokens and ``distinct`` ones, ends among them, the lattice and the log probability of the end."""

    training: int
    distinct: int
    ends: int
    lattice: Lattice
    log_end: float

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.training + self.distinct + 1))


def fit(words: DataFrame, ends: int, weights: dict[bytes, float], rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """Learn from a table of words (``entry``, ``n`` times in training documents) and the number of training documents.

    Without training documents the vocabulary's own probabilities stay. To the driver come two numbers and, in each round, a number for each piece.
    """
    known = words.filter("n > 0")
    size = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    spark, lattice = words.sparkSession, Lattice.of(weights)
    first = np.fromiter(weights.values(), float)
    log_end = math.log(prior / (prior + prior))  # one end for one piece, until ends are counted
    for _ in range(rounds if ends else 0):
        sent = spark.sparkContext.broadcast(lattice)  # as large as the vocabulary

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(len(sent.value.log))
            for table in larger(batches):
                weight = table.column("n").to_numpy().astype(float)
                for rows, block in by_length(table.column("entry").combine_chunks()):
                    found += sent.value.expected(block, weight[rows])
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["piece", "n"])

        table = known.select("entry", "n").mapInArrow(count, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        found = prior * first
        found[table.column("piece").to_numpy()] += table.column("n").to_numpy()
        total = found.sum() + ends
        lattice = Lattice(lattice.edges, lattice.targets, lattice.piece, np.log(found / total))
        log_end = math.log(ends / total)
        sent.destroy()
    if not ends or not rounds:  # pieces and end share the probability
        lattice = Lattice(lattice.edges, lattice.targets, lattice.piece, np.log(first / 2))
    return Model(int(size[1]) + ends, int(size[0]) + (ends > 0), ends, lattice, log_end)


def left_out(key: str = "doc_id") -> Column:
    """Whether a document is left out of learning; NULL keys never are."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == LEFT_OUT, F.lit(False))


def _chunks(docs: DataFrame, text: str, key: str, held: Column) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part]]:
        for rows, data, offsets in pieces(batches):
            words = find_words(data, offsets, lower=True)
            names, at, place = np.unique(words.name, return_index=True, return_inverse=True)
            a, b = int(offsets[0]), int(offsets[-1])
            body = _LOWER[data[a:b]].tobytes()
            entries = [body[i:j] for i, j in zip((words.start[at] - a).tolist(), (words.stop[at] - a).tolist())]
            doc = words.doc
            learns = ~rows.column(1).to_numpy(zero_copy_only=False)
            numbers = np.bincount(place[learns[doc]], minlength=len(names)).astype(np.int64)
            yield b - a, Part(rows.column(0), rows.column(1), entries, names, numbers, *tally(doc, place, rows.num_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunked(parts(batches), pa.binary(), pa.bool_())

    plain = docs.select(F.col(key).alias("key"), held.alias("held"), F.col(text).cast("string").alias("text"))
    return written(plain.mapInArrow(run, fields(kind, "binary", "boolean")))


def marginals(words: DataFrame, model: Model) -> DataFrame:
    """Rows ``entry``, ``n``, ``log`` (natural log of the word's marginal probability)."""
    sent = words.sparkSession.sparkContext.broadcast(model.lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in larger(batches):
            found = np.zeros(table.num_rows)
            for rows, block in by_length(table.column("entry").combine_chunks()):
                found[rows] = sent.value.marginal(block)
            yield from table.append_column("log", pa.array(found)).to_batches()

    return words.select("entry", "n").mapInArrow(run, "entry binary, n long, log double")


def text_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", held: Column | None = None, weights: dict[bytes, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10 of the marginal probability).

    Tokens are the words with A-Z lower-cased, then one end. ``held`` (boolean, not NULL) marks the rows left out of learning. NULL and empty
    texts are the end alone. Repeated rows are learnt from and scored as often as they stand; NULL keys are learnt from and kept. A
    very long text is a chunk of its own, a very long word a lattice of its own. Other columns are left out. Empty tables give no rows.
    """
    lean(docs.sparkSession)
    held, kind = left_out(key) if held is None else held, docs.schema[key].dataType.simpleString()
    chunks = _chunks(docs, text, key, held)
    ends = chunks.select(F.explode("marks").alias("m")).filter("not m").count()
    words = totals(chunks)
    model = fit(words, ends, weights or vocabulary(), rounds)
    values = written(marginals(words, model))
    training, distinct, end, log_end = model.training, model.distinct, model.ends, model.log_end

    def judge(keys: pa.Array, marks: pa.Array, doc: np.ndarray, place: np.ndarray, times: np.ndarray, table: pa.Table) -> pa.Table:
        count = table.column("n").to_numpy()
        size = math.log10(training + distinct + 1)
        sums = {"n_tokens": np.ones(len(count)), "n_known": count > 0, "base_score": np.log10(count + 1) - size, "score": table.column("log").to_numpy() / math.log(10)}
        own = {"n_tokens": 1, "n_known": int(end > 0), "base_score": math.log10(end + 1) - size, "score": log_end / math.log(10)}
        found = {c: np.bincount(doc, weights=times * value[place], minlength=len(keys)) + own[c] for c, value in sums.items()}
        whole = {c: found[c].round().astype(np.int64) for c in ("n_tokens", "n_known")}
        return pa.table({key: keys, "held_out": marks, **whole, "train_tokens": np.full(len(keys), training), **{c: found[c] for c in ("base_score", "score")}})

    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered(chunks, values, judge, schema)


def op11(spark, folder: str) -> DataFrame:
    return text_scores(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))


def brute_marginal(word: bytes, log: dict[bytes, float]) -> float:
    """Probability of a word from all its segmentations, one by one; for tests."""
    def paths(rest: bytes) -> float:
        return 1.0 if not rest else sum(math.exp(log[rest[:n]]) * paths(rest[n:]) for n in range(1, len(rest) + 1) if rest[:n] in log)

    return paths(b" " + word)


def brute_force(texts: list[tuple[int | None, str | None]]) -> list[tuple]:
    """Key, held out, tokens, known ones, training tokens and base score of each text; for tests."""
    import zlib
    from collections import Counter

    split = [(k, k is not None and zlib.crc32(str(k).encode()) % FOLDS == LEFT_OUT, [*(t or "").encode().lower().split(), None]) for k, t in texts]
    count = Counter(w for _, out, words in split if not out for w in words)
    size = sum(count.values()) + len(count) + 1
    return [(k, out, len(words), sum(count[w] > 0 for w in words), sum(count.values()), sum(math.log10((count[w] + 1) / size) for w in words)) for k, out, words in split]
