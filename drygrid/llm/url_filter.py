"""URL filter: longest matching rule, else exact list membership by a cascade of Bloom filters.

The key universe is every host of the corpus. Level 0 encodes the listed hosts; level 1 encodes the unlisted hosts that level 0 takes
for listed; level 2 the listed hosts that level 1 takes for unlisted, and so on until a level errs on no host. The first level that
misses a host then decides exactly, for every host of the universe, and pages need no join.

A cascade is broadcast only up to ``MOST_BITS`` bits a level; longer lists are split by host hash into blocks with a cascade each, and
every block judges its own pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from drygrid.llm.common import mix, written

BITS_PER_KEY, PROBES, MOST_BITS = 10, 7, 1 << 28
#: Rules as (host, path, verdict), and words that put a host on the list. Fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LISTED_WORDS = ("ads", "bets", "casino", "pills", "spam")


@dataclass
class Level:
    """A Bloom filter of ``size`` bits with its own hash functions."""

    number: int
    size: int
    words: np.ndarray | None = None

    def positions(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Bit positions (probes x keys) of keys given by two 64-bit hashes."""
        step = np.arange(PROBES, dtype=np.uint64)[:, None] + np.uint64(self.number * PROBES + 1)
        return mix(one.view(np.uint64) + step * (two.view(np.uint64) | np.uint64(1))) % np.uint64(self.size)

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        at = self.positions(one, two)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)


class Cascade:
    """Levels in order; :meth:`listed` is exact for every host of the universe it was built over."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def listed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.full(len(one), len(self.levels) % 2 == 1)
        todo = np.arange(len(one))
        for k, level in enumerate(self.levels):
            hit = level.has(one[todo], two[todo])
            out[todo[~hit]] = k % 2 == 1
            todo = todo[hit]
        return out


def _hashes(host: Column) -> list[Column]:
    return [F.xxhash64(host, F.lit(1)).alias("_one"), F.xxhash64(host, F.lit(2)).alias("_two")]


def _probe(test):
    """Column function of the two hashes that applies ``test`` to whole batches."""
    @F.arrow_udf(T.BooleanType())
    def run(one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array(test(one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)))
    return run("_one", "_two")


def _encode(keys: DataFrame, number: int, n: int) -> Level:
    level = Level(number, max(64, n * BITS_PER_KEY))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(level.size // 64 + 1, dtype=np.uint64)
        for batch in batches:
            at = level.positions(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))).ravel()
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], names=["word", "bits"])

    table = keys.select("_one", "_two").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    words = np.zeros(level.size // 64 + 1, dtype=np.uint64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return Level(number, level.size, words)


def build(universe: DataFrame) -> Cascade:
    """Cascade over ``universe`` (``_one``, ``_two``, ``listed``; a written table of distinct hosts)."""
    levels: list[Level] = []
    mine, others = universe.filter("listed"), universe.filter("not listed")
    while n := mine.count():
        level = _encode(mine, len(levels), n)
        levels.append(level)
        mine, others = others.filter(_probe(level.has)), mine  # who is taken for a member now has to be told apart
    return Cascade(levels)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for NULL or without ``://``."""
    parts = [F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return F.translate(parts[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), parts[1]


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits host or parent domain and the start of the path; NULL if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def listed_by_words(host: Column, words=LISTED_WORDS) -> Column:
    """Whether a dot- or hyphen-separated part of the host is a listed word."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(w) for w in words]))


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; ``listed`` (``host``) is the block list, of any size.

    NULL URLs and those without ``://`` have an empty host, which is listed only if the list says so. Listed hosts that no page has do
    not matter; a NULL in the list is ignored, repeated hosts count once. Columns of ``pages`` with these names are replaced. Empty
    pages give no rows, an empty list allows what no rule blocks.
    """
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(url))
    parts = pages.select(*columns, host.alias("host"), path.alias("path"))
    marks = listed.select("host").filter("host is not null").distinct().withColumn("listed", F.lit(True))
    universe = written(parts.select("host").distinct().join(marks, "host", "left").select("host", *_hashes(F.col("host")), F.coalesce("listed", F.lit(False)).alias("listed")))
    # every level but the first encodes at most the larger of both sides
    blocks = max(1, -(-universe.count() * BITS_PER_KEY // most_bits))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ready = parts.select("*", rule.alias("rule"), verdict.alias("_verdict"), *_hashes(F.col("host")))
    out = None
    for b in range(blocks):
        mine = (lambda df: df.filter(F.pmod(F.col("_one"), F.lit(blocks)) == b)) if blocks > 1 else (lambda df: df)
        part = mine(ready).withColumn("_listed", _probe(build(mine(universe)).listed))
        out = part if out is None else out.unionByName(part)
    return out.select(*columns, "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"))


def op10(spark, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    hosts = pages.select(split_url(F.col("url"))[0].alias("host")).distinct()
    return judge(pages, hosts.filter(listed_by_words(F.col("host")))).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
found AS (
  SELECT *, (SELECT max_by({'rule': h || p, 'verdict': v}, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r FROM parts)
SELECT page_id, host, path, r.rule AS rule,
       coalesce(r.verdict, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), ['ads', 'bets', 'casino', 'pills', 'spam']) THEN 'block' ELSE 'allow' END) AS verdict
FROM found
"""
