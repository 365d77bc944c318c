"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

A solution is a grouping of items into bins. Crossover injects whole well-filled bins of one parent into the other, removes the bins
there that share items with them, and best-fits the displaced items in descending order; mutation dissolves the emptiest bins the
same way. Items of the corpus are dealt at random into shards of about ``SHARD`` items, so a solution stays small whatever the
corpus. Every shard is evolved on several islands at once, each a row of a table and a task's work; after every epoch the best
solution of each island moves to the next one through a shuffle. The best island of a shard wins.

Full pieces (as long as a sequence) need no packing and form sequences of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from drygrid.llm.common import lean, shuffled, written

CAPACITY, END = 1024, 2
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 16384, 3, 3, 5, 4
LOT = 65536  # copies of one row numbered at once
_UNUSUAL = re.compile("[^\x09\x0a\x20-ɏ]|<\\|endoftext\\|>")


class Tokens:
    """Token ids of the vocabulary in ``tokenizer`` (``tokenizers`` JSON).

    ``ranks``, the same vocabulary for ``tiktoken``, speeds up texts of Latin letters without special strings; both give the same ids
    there, which a test asserts. All other texts take the ``tokenizers`` library.
    """

    def __init__(self, tokenizer: str, ranks: str | None) -> None:
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(tokenizer), None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not _UNUSUAL.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def vocabulary() -> tuple[str, str]:
    """Paths of the public byte-level vocabulary, for ``tokenizers`` and for ``tiktoken``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: all full, but for the first, which takes the rest."""
    rest = total % capacity
    return ([rest] if rest else []) + [capacity] * (total // capacity)


# --- one island ----------------------------------------------------------------------------------------


def best_fit(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, room: list[int], capacity: int) -> None:
    """Put ``items`` (longest first) each into the fullest bin that takes it, or a new one. Changes ``bins`` and ``room``."""
    by_room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r: some bin has room r
    for b, r in enumerate(room):
        if r > 0:
            by_room.setdefault(r, []).append(b)
            open_rooms |= 1 << r
    order = items[np.argsort(-sizes[items], kind="stable")]
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = open_rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            here = by_room[r]
            b = here.pop()
            if not here:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[item] = b
        left = r - size
        room[b] = left
        if left:
            by_room.setdefault(left, []).append(b)
            open_rooms |= 1 << left


def exact_fill(sizes: np.ndarray, capacity: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """Longest items first, each bin filled up by one or two items that fit exactly, else by the longest that fits.

    ``rng`` starts the search for pairs at random places, for solutions that differ.
    """
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for item in np.argsort(sizes, kind="stable").tolist():
        stock[sizes[item]].append(item)
    bins, number = np.zeros(len(sizes), dtype=np.int64), 0
    for longest in range(capacity, 0, -1):
        while stock[longest]:
            taken, left, most = [stock[longest].pop()], capacity - longest, longest
            while left:
                if left <= most and stock[left]:
                    parts = (left,)
                else:
                    low, high = (left + 1) // 2, min(most, left - 1)
                    first = high if rng is None or high <= low else int(rng.integers(low, high + 1))
                    pair = next((a for a in (*range(first, low - 1, -1), *range(high, first, -1)) if stock[a] and stock[left - a] and (2 * a != left or len(stock[a]) > 1)), 0)
                    one = min(most, left)
                    while not pair and one and not stock[one]:
                        one -= 1
                    parts = (pair, left - pair) if pair else (one,) if one else ()
                if not parts:
                    break
                for part in parts:
                    taken.append(stock[part].pop())
                    left -= part
            bins[taken] = number
            number += 1
    return bins


def _compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def _swap(sizes: np.ndarray, bins: np.ndarray, room: list[int], loose: np.ndarray, capacity: int) -> np.ndarray:
    """Exchange loose items for smaller ones of bins that they then fill to the brim, one item a bin; what is loose afterwards."""
    space = np.array(room, dtype=np.int64)
    held = np.ones(len(bins), dtype=bool)
    held[loose] = False
    inside = np.flatnonzero(held)
    inside = inside[space[bins[inside]] > 0]
    wanted = sizes[inside] + space[bins[inside]]  # the size that would fill the bin in place of this item
    order = np.argsort(wanted, kind="stable")
    inside, wanted = inside[order], wanted[order]
    at = np.searchsorted(wanted, np.arange(capacity + 2)).tolist()
    after = []
    for item in loose[np.argsort(-sizes[loose], kind="stable")].tolist():
        size = int(sizes[item])
        k = at[size]
        while k < at[size + 1] and not room[bins[inside[k]]]:
            k += 1
        at[size] = min(k + 1, at[size + 1])
        if k < at[size + 1]:
            other = int(inside[k])
            bins[item], room[bins[other]] = bins[other], 0
            item = other
        after.append(item)
    return np.array(after, dtype=np.int64)


def _regroup(sizes: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Swap the ``loose`` items for smaller ones where that fills a bin, then best-fit them into the bins that the others form."""
    child = bins.copy()
    fixed = np.flatnonzero(~loose)
    child[fixed] = _compact(bins[fixed])
    room = (capacity - np.bincount(child[fixed], weights=sizes[fixed])).astype(int).tolist() if len(fixed) else []
    items = np.flatnonzero(loose)
    if room:
        items = _swap(sizes, child, room, items, capacity)
    best_fit(sizes, items, child, room, capacity)
    return child


def crossover(sizes: np.ndarray, one: np.ndarray, other: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """Inject a random half of the better-filled bins of ``other`` into ``one``."""
    fill = np.bincount(other, weights=sizes)
    good = np.flatnonzero(fill >= np.median(fill))
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[good[rng.random(len(good)) < 0.5]] = True
    injected = chosen[other]
    broken = np.zeros(int(one.max()) + 1, dtype=bool)
    broken[one[injected]] = True
    merged = np.where(injected, other + len(broken), one)
    return _regroup(sizes, merged, broken[one] & ~injected, capacity)


def mutate(sizes: np.ndarray, bins: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """Dissolve the emptiest bins and as many others."""
    fill = np.bincount(bins, weights=sizes)
    some = min(len(fill), max(2, len(fill) // 50))
    gone = np.zeros(len(fill), dtype=bool)
    gone[np.argsort(fill, kind="stable")[:some]] = True
    gone[rng.integers(0, len(fill), some)] = True
    return _regroup(sizes, bins, gone[bins], capacity)


def fitness(sizes: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: smaller is better."""
    fill = np.bincount(bins, weights=sizes)
    return len(fill), -float((fill**2).sum())


def evolve(sizes: np.ndarray, population: list[np.ndarray], seed: int, capacity: int = CAPACITY, generations: int = GENERATIONS, keep: int = POPULATION) -> list[np.ndarray]:
    """Some generations on one island; the best ``keep`` solutions, best first. An empty population is filled first, by best fit and
    by exact filling."""
    rng = np.random.default_rng(seed)
    while len(population) < keep:
        if population:
            population.append(exact_fill(sizes, capacity, rng if len(population) > 1 else None))
        else:
            bins: np.ndarray = np.zeros(len(sizes), dtype=np.int64)
            best_fit(sizes, np.arange(len(sizes)), bins, [], capacity)
            population.append(bins)
    least = -(-int(sizes.sum()) // capacity)
    population = sorted(population, key=lambda p: fitness(sizes, p))[:keep]
    for _ in range(generations):
        if fitness(sizes, population[0])[0] == least:
            break  # no packing has fewer bins
        a, b = rng.choice(len(population), 2, replace=False)
        children = [crossover(sizes, population[a], population[b], rng, capacity), mutate(sizes, population[min(a, b)], rng, capacity)]
        population = sorted(population + children, key=lambda p: fitness(sizes, p))[:keep]
    return population


# --- the corpus ----------------------------------------------------------------------------------------


def _bytes(values: np.ndarray) -> bytes:
    return values.astype("<u2").tobytes()


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2").astype(np.int64)


def _epoch(number: int, capacity: int):
    """Evolve every island row; each row goes on and sends its best solution to the next island."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = _array(row["sizes"])
                known = [_array(m) for m in row["members"]]
                found = evolve(sizes, known, hash((row["shard"], row["island"], number)) & 0xFFFFFFFF, capacity)
                yield pa.RecordBatch.from_pylist([
                    {"shard": row["shard"], "island": row["island"], "sizes": row["sizes"], "members": [_bytes(m) for m in found]},
                    {"shard": row["shard"], "island": (row["island"] + 1) % ISLANDS, "sizes": None, "members": [_bytes(found[0])]}], schema=_ISLAND)
    return run


_ISLAND = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("members", pa.list_(pa.binary()))])


def tokenised(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None,
              ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: key, ``n`` (ids with the end id), ``crcs`` (CRC-32 of each piece's ids) and, if wanted, ``ids`` of each piece."""
    lean(docs.sparkSession)
    if tokenizer is None:
        tokenizer, ranks = vocabulary()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer, ranks)
        for batch in batches:
            n, crcs, ids = [], [], []
            for value in batch.column(1):
                found = np.array([*tokens(value.as_py() or ""), end], dtype="<u4")
                edges = np.cumsum([0, *cut_lengths(len(found), capacity)]).tolist()
                parts = [found[a:b] for a, b in zip(edges, edges[1:])]
                n.append(len(found))
                crcs.append([zlib.crc32(p.tobytes()) for p in parts])
                ids.append([p.astype(np.int32) for p in parts] if with_ids else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))] + ([pa.array(ids, pa.list_(pa.list_(pa.int32())))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "crcs", "ids"][: len(columns)])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n long, crcs array<long>" + (", ids array<array<int>>" if with_ids else ""))


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False, shard: int = SHARD, **tokens) -> DataFrame:
    """One row per piece: key, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, if wanted, ``ids``.

    Documents are tokenised, ended by one id and cut only if longer than ``capacity``: into full pieces, of which the first takes the
    rest. NULL and empty texts are one end id. Repeated rows and NULL keys are packed like all others. Offsets in a sequence are
    gapless from 0. Empty tables give no rows.
    """
    found = written(tokenised(docs, text, key, capacity, with_ids=with_ids, **tokens))
    shards = max(1, -(-found.count() // shard))
    rest, full = (F.col("n") % capacity).cast("int"), F.floor(F.col("n") / capacity).cast("long")
    # Rows are dealt by a hash of what they are, repeated rows also by their number: the deal depends on neither files nor tasks.
    copies = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("copies"))
    copies = copies.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / LOT))))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("lot") * LOT, F.least(F.col("copies"), (F.col("lot") + 1) * LOT) - 1)))
    dealt = copies.select(*found.columns, F.pmod(F.xxhash64("key", "n", "crcs", "copy"), F.lit(shards)).cast("long").alias("shard"), rest.alias("rest"), full.alias("full"))
    order = Window.partitionBy("shard").orderBy(F.col("rest").desc(), "key", "crcs")
    items = written(dealt.withColumn("slot", F.row_number().over(order) - 1))

    listed = items.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("slot", "rest"))).alias("s"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array([x["rest"] for x in row["s"] if x["rest"]], dtype=np.int64)  # slots are longest first: no rest comes last
                if len(sizes):
                    yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "island": i, "sizes": _bytes(sizes), "members": []} for i in range(ISLANDS)], schema=_ISLAND)

    schema = "shard long, island int, sizes binary, members array<binary>"
    state = listed.mapInArrow(start, schema)
    for number in range(EPOCHS):
        moved = state.repartition(shards * ISLANDS, "shard", "island").mapInArrow(_epoch(number, capacity), schema)
        state = moved.groupBy("shard", "island").agg(F.max("sizes").alias("sizes"), F.flatten(F.collect_list("members")).alias("members"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = _array(row["sizes"])
                bins = min((_array(m) for m in row["members"]), key=lambda p: fitness(sizes, p))
                by = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[by])
                first = np.searchsorted(bins[by], np.arange(bins.max() + 1))
                offset = ends - sizes[by] - (ends - sizes[by])[first][bins[by]]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(by), pa.int64()), pa.array(by.astype(np.int32)), pa.array(bins[by]), pa.array(offset)],
                                                 names=["shard", "slot", "bin", "place"])

    best = state.groupBy("shard").agg(F.max("sizes").alias("sizes"), F.flatten(F.collect_list("members")).alias("members"))
    placed = best.mapInArrow(places, "shard long, slot int, bin long, place long")
    before = F.coalesce(F.sum("full").over(Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = items.withColumn("before", before).join(shuffled(placed), ["shard", "slot"], "left")
    lead = (F.col("rest") > 0).cast("long")
    piece = F.explode(F.sequence(F.lit(0), (F.col("full") + lead - 1).cast("int"))).alias("piece")
    rows = joined.select("*", lead.alias("lead"), piece)
    short = (F.col("lead") == 1) & (F.col("piece") == 0)
    number = F.col("piece") - F.col("lead")
    # even numbers: packed sequences; odd numbers: full pieces, counted along the shard
    sequence = F.when(short, F.col("bin") * 2).otherwise((F.col("before") + number) * 2 + 1)
    out = rows.select(
        F.col("key").alias(key), "piece", F.when(short, 0).otherwise(F.col("rest") + number * capacity).cast("long").alias("start"),
        F.when(short, F.col("rest")).otherwise(capacity).cast("long").alias("length"), F.get("crcs", F.col("piece")).alias("ids_crc32"),
        (F.shiftleft(F.col("shard"), 36) + sequence).cast("long").alias("sequence_id"), F.when(short, F.col("place")).otherwise(0).cast("long").alias("offset"),
        *([F.get("ids", F.col("piece")).alias("ids")] if with_ids else []))
    return out


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences (``sequence_id``, ``ids``) of pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op2(spark, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
