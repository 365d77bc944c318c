"""Alignment of two tokenisers' tokens by lockstep merging.

Both tokenisers cut the same bytes. For each document a pointer into its A tokens and one into its B tokens walk along: a step links the two
tokens pointed at, then moves the pointer of the token that ends first, or both where they end together, which is a cut between groups.
One state vector holds the pointers of all documents of a batch, so a step is a few NumPy operations for all of them; documents that are
done leave the vector.

Counts of linked id pairs over the corpus come from chunk dictionaries (:mod:`drygrid.llm.exchange`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drygrid.llm.common import lean, pieces, written
from drygrid.llm.exchange import Part, answered, chunked, fields, tally, totals

STEP = 1 << 22  # bytes of text walked at once
_UNUSUAL = re.compile("[^\x09\x0a\x20-ɏ]")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def vocabularies() -> tuple[str, str, str]:
    """Paths of the public vocabularies: A for ``tokenizers``, A for ``tiktoken``, B for ``sentencepiece``."""
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


def _byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Ids of a text by A (with a leading space) and by B, and the bytes of every id.

    ``ranks``, A's vocabulary for ``tiktoken``, serves texts of Latin letters; both libraries give the same ids there. Other texts take ``tokenizers``.
    """

    def __init__(self, a: str, ranks: str | None, b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(a), None
        self.slow.encode_special_tokens = True  # their strings in a text are plain text
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b)
        codes = _byte_table()
        special = {i: t.content.encode() for i, t in self.slow.get_added_tokens_decoder().items()}
        self.a = [special[i] if i in special else bytes(codes[c] for c in self.slow.id_to_token(i)) for i in range(self.slow.get_vocab_size())]
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.b = [bytes.fromhex(_BYTE.fullmatch(n)[1]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.lengths = [np.array([len(x) for x in table], dtype=np.int64) for table in (self.a, self.b)]

    def __call__(self, text: str) -> tuple[list[int], list[int]]:
        """Ids by A and B; none where the bytes of either are not those of the text behind a space."""
        if not text:
            return [], []
        spaced = " " + text
        a = self.fast.encode_ordinary(spaced) if self.fast is not None and not _UNUSUAL.search(text) else self.slow.encode(spaced, add_special_tokens=False).ids
        b = self.pieces.encode(text)
        whole = spaced.encode()
        if b"".join([self.a[i] for i in a]) != whole or b"".join([self.b[i] for i in b]) != whole:
            return [], []
        return a, b


@lru_cache(maxsize=2)
def _tokenizers(a: str, ranks: str | None, b: str) -> Tokenizers:
    return Tokenizers(a, ranks, b)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts of all documents of a batch.

    ``a_ends``, ``b_ends``: end of each token in its document; ``a_first``, ``b_first``: number of each document's first token. Both sides of a
    document end at the same byte. Returns the token numbers of the links (A, B), and marks of the A and B tokens that a cut follows.
    """
    most = len(a_ends) + len(b_ends)
    links_a, links_b = np.empty(most, dtype=np.int32), np.empty(most, dtype=np.int32)
    a_cut, b_cut = np.zeros(len(a_ends), dtype=bool), np.zeros(len(b_ends), dtype=bool)
    live = np.flatnonzero(np.diff(a_first))
    a, b, stop = a_first[live].copy(), b_first[live].copy(), a_first[live + 1]
    made = 0
    while len(a):
        links_a[made : made + len(a)] = a
        links_b[made : made + len(b)] = b
        made += len(a)
        x, y = a_ends[a], b_ends[b]
        a_moves, b_moves = x <= y, y <= x
        cut = a_moves & b_moves
        a_cut[a[cut]] = True
        b_cut[b[cut]] = True
        a = a + a_moves
        b = b + b_moves
        going = a < stop
        if not going.all():  # documents that are done leave
            a, b, stop = a[going], b[going], stop[going]
    return links_a[:made], links_b[:made], a_cut, b_cut


@dataclass
class Batch:
    """Aligned documents: ids and first tokens of both sides, links by token number, marks of tokens that a cut follows."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    a_ends: np.ndarray


def align_texts(texts: list[str | None], tokenizers: Tokenizers) -> Batch:
    sides: tuple[list, list] = ([], [])
    for text in texts:
        for side, ids in zip(sides, tokenizers(text or "")):
            side.append(np.array(ids, dtype=np.int32))
    ids, firsts, ends = [], [], []
    for side, lengths in zip(sides, tokenizers.lengths):
        flat = np.concatenate([*side, np.zeros(0, np.int32)])
        first = np.cumsum([0, *map(len, side)])
        total = np.concatenate(([0], np.cumsum(lengths[flat])))
        ids.append(flat)
        firsts.append(first)
        ends.append(total[1:] - np.repeat(total[first[:-1]], np.diff(first)))
    return Batch(*ids, *firsts, *lockstep(*ends, *firsts), ends[0])


@lru_cache(maxsize=1)
def _written_ids(size: int) -> tuple[list[bytes], ...]:
    return tuple([b"%d%c" % (i, mark) for i in range(size)] for mark in b",|;")


def group_digests(batch: Batch) -> list[str]:
    """SHA-256 of each document's groups, written ``a1,a2|b1;a3|b2,b3``; '' for a document without tokens."""
    a_stop, b_stop = np.flatnonzero(batch.a_cut) + 1, np.flatnonzero(batch.b_cut) + 1
    a_group = np.concatenate(([0], np.cumsum(batch.a_cut)))[:-1]
    b_group = np.concatenate(([0], np.cumsum(batch.b_cut)))[:-1]
    # a group's A tokens come behind all B tokens of the groups before it, its B tokens behind its A tokens
    a_place = np.arange(len(batch.a)) + np.concatenate(([0], b_stop))[a_group]
    b_place = np.arange(len(batch.b)) + a_stop[b_group] if len(batch.b) else np.zeros(0, np.int64)
    size = int(max(batch.a.max(initial=0), batch.b.max(initial=0))) + 1
    comma, bar, semicolon = _written_ids(1 << (size - 1).bit_length())
    names = [*comma, *bar, *semicolon]
    step = len(comma)
    code = np.empty(len(batch.a) + len(batch.b), dtype=np.int64)
    code[a_place] = batch.a + step * batch.a_cut
    code[b_place] = batch.b + 2 * step * batch.b_cut
    first = batch.a_first + batch.b_first
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(hashlib.sha256(b"".join([names[k] for k in code[i:j].tolist()])[:-1]).hexdigest() if j > i else "")
    return out


def alignments(docs: DataFrame, text: str = "text", key: str = "doc_id", paths: tuple[str, str | None, str] | None = None) -> DataFrame:
    """Per row of ``docs``: key, ``a_ids``, ``b_ids``, ``links`` (places of an A and a B token whose bytes overlap, in order) and ``cuts`` (byte
    offsets in space + text where both end).

    NULL and empty texts, and those that either tokeniser does not give back byte by byte, have empty lists. Repeated rows and NULL keys
    are aligned like all others; other columns are left out, so they cannot clash. Empty tables give no rows.
    """
    lean(docs.sparkSession)
    paths, kind = paths or vocabularies(), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizers(*paths)
        for rows, _, _ in pieces(batches):
            found = align_texts(rows.column(1).to_pylist(), tokens)
            doc = np.repeat(np.arange(rows.num_rows), np.diff(found.a_first))[found.links_a]
            order = np.lexsort((found.links_b, found.links_a, doc))  # links come step by step
            doc = doc[order]
            pair = pa.StructArray.from_arrays([pa.array((x - f[doc]).astype(np.int32)) for x, f in ((found.links_a[order], found.a_first), (found.links_b[order], found.b_first))], names=["a", "b"])
            many = lambda first, values: pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)
            cut = np.flatnonzero(found.a_cut)
            yield pa.RecordBatch.from_arrays([
                rows.column(0), many(found.a_first, pa.array(found.a)), many(found.b_first, pa.array(found.b)), many(np.searchsorted(doc, np.arange(rows.num_rows + 1)), pair),
                many(np.searchsorted(cut, found.a_first), pa.array(found.a_ends[cut].astype(np.int32)))], names=[key, "a_ids", "b_ids", "links", "cuts"])

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, f"`{key}` {kind}, a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int>>, cuts array<int>")


_MARKS = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])


def _chunks(docs: DataFrame, text: str, key: str, paths: tuple[str, str | None, str]) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part]]:
        tokens = _tokenizers(*paths)
        held: list[pa.RecordBatch] = []
        weight = 0

        def walked() -> Part:
            keys = pa.concat_arrays([rows.column(0) for rows in held])
            found = align_texts([t for rows in held for t in rows.column(1).to_pylist()], tokens)
            doc = np.repeat(np.arange(len(keys)), np.diff(found.a_first))
            link_doc = doc[found.links_a]
            code = found.a[found.links_a].astype(np.int64) * len(tokens.b) + found.b[found.links_b]
            first, entry, times = tally(link_doc, code, len(keys))
            entries, place = np.unique(entry.astype(np.int64), return_inverse=True)
            marks = pa.StructArray.from_arrays([
                pa.array(np.diff(found.a_first)), pa.array(np.diff(found.b_first)), pa.array(np.bincount(doc[found.a_cut], minlength=len(keys))),
                pa.array(np.bincount(link_doc, minlength=len(keys))), pa.array(group_digests(found), pa.string())], fields=list(_MARKS))
            numbers = np.bincount(place, weights=times, minlength=len(entries)).astype(np.int64)
            return Part(keys, marks, entries, entries.astype(np.uint64), numbers, first, place, times)

        for rows, _, offsets in pieces(batches):
            held.append(rows)
            weight += int(offsets[-1] - offsets[0])
            if weight >= STEP:
                yield weight, walked()
                held, weight = [], 0
        if held:
            yield weight, walked()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunked(parts(batches), pa.int64(), _MARKS)

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    mark = "struct<n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>"
    return written(plain.mapInArrow(run, fields(kind, "long", mark)))


def pair_counts(chunks: DataFrame, b_size: int) -> DataFrame:
    """Rows ``entry`` (A id * ``b_size`` + B id), ``n`` (links of the corpus that hold the pair) and ``best`` (no pair of this B id has more)."""
    found = totals(chunks)
    b_id = F.pmod("entry", F.lit(b_size))
    top = found.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))  # a row for each B id at most
    return found.join(F.broadcast(top), b_id == F.col("b")).select("entry", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment_report(docs: DataFrame, text: str = "text", key: str = "doc_id", paths: tuple[str, str | None, str] | None = None) -> DataFrame:
    """Per row of ``docs``: key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``n_best``: links whose pair is linked no less often in the corpus than any other pair of the same B id; ``count_sum``: sum over the links of
    how often their pair is linked. Texts without tokens (see :func:`alignments`) give zeros and ''. Repeated rows count as often as they stand; NULL
    keys are kept; a very long text is a chunk of its own; other columns are left out. Empty tables give no rows.
    """
    lean(docs.sparkSession)
    paths, kind = paths or vocabularies(), docs.schema[key].dataType.simpleString()
    chunks = _chunks(docs, text, key, paths)

    def judge(keys: pa.Array, marks: pa.Array, doc: np.ndarray, place: np.ndarray, times: np.ndarray, table: pa.Table) -> pa.Table:
        n, best = table.column("n").to_numpy(), table.column("best").to_numpy().astype(np.int64)
        sums = [np.zeros(len(keys), dtype=np.int64) for _ in range(2)]
        for total, value in zip(sums, (best, n)):
            np.add.at(total, doc, times * value[place])
        plain = dict(zip([f.name for f in _MARKS], marks.flatten()))
        return pa.table({key: keys, **{c: plain[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": plain["groups_sha256"]})

    schema = f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=paths[2]).vocab_size()
    return answered(chunks, written(pair_counts(chunks, size)), judge, schema)


def op12(spark, folder: str) -> DataFrame:
    return alignment_report(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))


def brute_force(texts: list[tuple[int, str | None]], tokenizers: Tokenizers) -> list[tuple]:
    """The same from all pairs of tokens of a document; for tests."""
    from collections import Counter

    docs = []
    for k, text in texts:
        a, b = tokenizers(text or "")
        spans = []
        for ids, table in ((a, tokenizers.a), (b, tokenizers.b)):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at + len(table[i])))
                at += len(table[i])
            spans.append(side)
        links = [(x, y) for x, p, q in spans[0] for y, r, s in spans[1] if p < s and r < q]
        ends = sorted({q for _, _, q in spans[0]} & {s for _, _, s in spans[1]})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, p, q in side if before <= p and q <= end) for side in spans))
            before = end
        docs.append((k, len(a), len(b), groups, links))
    counts = Counter(link for *_, links in docs for link in links)
    best: dict[int, int] = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return [(k, n_a, n_b, len(groups), len(links), sum(counts[x, y] == best[y] for x, y in links), sum(counts[link] for link in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for k, n_a, n_b, groups, links in docs]
