"""Audit of how filters overlap, kept current over a stream of files by retractions.

Five filters judge a document: A under ``LEAST_WORDS`` words, B too few distinct words, C too many capitals, D a mark of ``MARKS``, E a
text that a smaller id has as well. A to D depend on the document alone. E depends on all documents, so a verdict given in one
micro-batch can be wrong after the next one.

All files are read as micro-batches until none is left. Each row becomes a slim one (hash of the text, part, mask of the failures A to D,
flags of the labels); rows alike are combined inside their task, so a text that a third of all rows have costs a few rows a task. The state
of a text holds its least id and the masks counted under it. A smaller id retracts these masks (count -n) and counts them again
with E (count +n); all ids that are not the least are counted with E at once. The changes are written as they come; part counters are their sums.

States are kept by buckets of texts, ``BUCKETS`` for each state partition, so Python merges many texts by one vectorised step instead of
one call a text (6 ms each). Whoever sizes the shuffle partitions to the memory of a task has sized a bucket to a quarter of that.

Whatever order the filters run in, a document is removed by the first one that it fails. So the counters by part and mask give all
orders: nothing is replayed.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from drygrid.llm.common import shared_folder, shuffled, written

FILTERS = "ABCDE"
LEAST_WORDS, VARIETY, CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
SHARED, GOOD, TOXIC, NAMELESS = 16, 32, 64, 128  # bits of a mask beside those of A to D; the last one is used inside only
FILES = 64  # files of a micro-batch
SALTS = 8  # the labels of one key meet its rows in so many places
COMBINED = 1 << 16  # slim rows that a task combines at once
BUCKETS = 4  # of texts, for each state partition
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
          "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}  # else each state partition reserves 4 MB of disk, however small its state
_CHANGE = ["part", "mask", "n"]
_HELD = {"name": pa.binary(), "id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "n": pa.int64()}


def failures(text: str = "text") -> Column:
    """Mask of the filters A to D (bits 1, 2, 4, 8) that a text fails; NULL counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, SPACE), "")
    marks = [F.size(words) < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < VARIETY * F.size(words),
             100 * F.length(F.regexp_replace(body, "[^A-Z]+", "")) > CAPITALS * F.length(body), body.rlike(MARKS)]
    return sum((mark.cast("int") * (1 << k) for k, mark in enumerate(marks)), F.lit(0))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows alike in text, part and mask become one: the least id, how many rows have it, and how many there are."""
    held: list[pa.RecordBatch] = []

    def flush():
        table = pa.Table.from_batches(held)
        held.clear()
        keys = ["name", "part", "mask"]
        ones = table.append_column("n", pa.array([1] * table.num_rows, pa.int64())).group_by([*keys, "id"]).aggregate([("n", "sum")])
        ones = ones.sort_by([("id", "ascending")])
        found = ones.group_by(keys, use_threads=False).aggregate([("id", "first"), ("n_sum", "first"), ("n_sum", "sum")])
        return found.rename_columns([*keys, "id", "least", "n"]).combine_chunks().to_batches()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= COMBINED:
            yield from flush()
    if held:
        yield from flush()


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counter changes of the texts of one bucket. Its state: for each text the least id and the (part, mask, rows) counted under it."""
    new = pd.concat(list(frames), ignore_index=True)
    out = [new[new["mask"] >= NAMELESS].assign(mask=lambda x: x["mask"] ^ NAMELESS)[_CHANGE]]
    new = new[new["mask"] < NAMELESS]
    old = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else new.head(0).drop(columns="least")
    text = pd.factorize(pd.concat([old["name"], new["name"]]))[0]
    ids = np.concatenate((old["id"].to_numpy(np.int64), new["id"].to_numpy(np.int64)))
    first = np.full(text.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, text, ids)
    leads = ids == first[text]
    stays, leads = leads[: len(old)], leads[len(old) :]
    moved = old[~stays]  # a smaller id has come: take back what was counted, count it again with E
    out += [moved.assign(n=-moved["n"])[_CHANGE], moved.assign(mask=moved["mask"] | SHARED)[_CHANGE]]
    least = np.where(leads, new["least"], 0)
    out += [new.assign(n=least)[_CHANGE], new.assign(mask=new["mask"] | SHARED, n=new["n"] - least)[_CHANGE]]
    held = pd.concat([old[stays], new[leads].assign(n=new["least"][leads]).drop(columns="least")]).groupby(["name", "id", "part", "mask"], as_index=False)["n"].sum()
    table = pa.table({c: pa.array(held[c], kind) for c, kind in _HELD.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))
    yield pd.concat(out).groupby(["part", "mask"], as_index=False)["n"].sum().query("n != 0")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Hold settings while a stream starts (it copies them), then put the session's own back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def files(spark: SparkSession, path: str, at_once: int = FILES) -> DataFrame:
    """A Parquet table (a folder or one file) as a stream, ``at_once`` files a micro-batch."""
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"  # the same path as a pattern: a stream takes a single file only so
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", at_once).parquet(pattern)


def counters(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """Rows ``part``, ``mask`` (bits A to E, GOOD, TOXIC) and ``n`` (above 0) after the stream ``docs`` has been read to its present end.

    A table that is no stream is written and read as one. Keys are integers. A NULL key has no label, never fails E and makes nobody fail it.
    Repeated rows count as often as they stand; those of the least key don't fail E. A key has a label if any of its rows in ``labels`` has it.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    if not docs.isStreaming:
        rows.write.parquet(f"{folder}/rows")
        rows = files(spark, f"{folder}/rows")
    said = labels.filter(F.col(key).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy(F.col(key).cast("long").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("toxic"))
    said = written(said).select("label_id", (F.col("good") + F.col("toxic")).alias("flags"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("label_salt"))
    name = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    slim = rows.select("id", "part", name.alias("name"), failures().alias("mask")).withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
    flagged = slim.join(shuffled(said), (F.col("id") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")), "left")
    flagged = flagged.select(F.coalesce("id", F.lit(0)).alias("id"), "part", "name", (F.col("mask") + F.when(F.col("id").isNull(), NAMELESS).otherwise(F.coalesce("flags", F.lit(0)))).alias("mask"))
    combined = flagged.mapInArrow(_combine, "name binary, part string, mask int, id long, least long, n long")

    schema = "part string, mask int, n long"
    out = f"{folder}/changes"
    spark.createDataFrame([], schema).write.parquet(out)  # there is a table even if the stream is empty
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucketed = combined.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)))
    changes = bucketed.groupBy("bucket").applyInPandasWithState(_changes, schema, "held binary", "append", GroupStateTimeout.NoTimeout)
    with _settings(spark, _STATE):
        query = changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out).groupBy("part", "mask").agg(F.sum("n").alias("n")).filter("n != 0")


def audit(counted: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``.

    ``counted`` is what :func:`counters` gives. The rows grow with the parts only; a part has at most 128 masks.
    """
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n")).alias("cells"))
    rows = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda letter: F.pow(F.lit(2), F.ascii(letter) - ord("A")).cast("int")
    letters = F.split("filter_order", "")
    before = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda found, letter: found + bit(letter))
    rows = rows.withColumn("own", bit(F.get(letters, F.col("step") - 1))).withColumn("before", before)

    def total(test, weight=lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda found, x: found + weight(x))

    def on(x, bits) -> Column:
        return x["mask"].bitwiseAND(bits) != 0

    own, earlier = F.col("own"), F.col("before")
    every = (1 << len(FILTERS)) - 1
    fails = lambda x: on(x, own)
    removed = lambda x: fails(x) & ~on(x, earlier)
    share = lambda x: (x["n"] * F.lit(len(ORDERS)) / F.bit_count(x["mask"].bitwiseAND(every))).cast("long")  # noqa: E731  first of its k failures in 1 of k orders
    return rows.select(
        "part", "filter_order", "step", total(lambda x: ~on(x, earlier) & ~on(x, own)).alias("kept"), total(removed).alias("removed"), total(lambda x: fails(x) & on(x, earlier)).alias("redundant"),
        total(lambda x: x["mask"].bitwiseAND(every) == own).alias("unique_fails"), total(lambda x: removed(x) & on(x, F.lit(GOOD))).alias("good_lost"),
        total(lambda x: removed(x) & on(x, F.lit(TOXIC))).alias("toxic_lost"), total(fails, share).alias("shapley"))


def op13(spark, folder: str) -> DataFrame:
    return audit(counters(files(spark, f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")))


def _fails(test: str, bit: int) -> str:
    return f"CASE WHEN {test} THEN {bit} ELSE 0 END"


_BODY = "coalesce(text, '')"
_WORDS = f"list_filter(string_split_regex({_BODY}, '{SPACE}'), lambda x: x <> '')"
_TESTS = [f"len(ws) < {LEAST_WORDS}", f"100 * len(list_distinct(ws)) < {VARIETY} * len(ws)", f"100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {CAPITALS} * length(t)",
          f"regexp_matches(t, '{MARKS}')", "doc_id > min(doc_id) OVER (PARTITION BY t)"]
_SUM = "coalesce(list_sum(list_transform(list_filter(cells, lambda x: {test}), lambda x: {value})), 0)::BIGINT AS {name}"
_REMOVED = "x.m & own <> 0 AND x.m & earlier = 0"
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, {_BODY} AS t, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1),
m AS (SELECT doc_id, part, {" + ".join(_fails(t, 1 << k) for k, t in enumerate(_TESTS))} AS m FROM d),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
p AS (SELECT part, list({{'m': m, 'n': n, 'g': g, 'b': b}}) AS cells FROM c GROUP BY 1),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || f FROM (SELECT filter_order, UNNEST(['A', 'B', 'C', 'D', 'E']) AS f FROM o WHERE length(filter_order) < 5) WHERE NOT contains(filter_order, f)),
r AS (SELECT part, cells, UNNEST((SELECT list(filter_order) FROM o WHERE length(filter_order) = 5)) AS filter_order FROM p),
s AS (SELECT part, cells, filter_order, UNNEST([1, 2, 3, 4, 5]) AS step FROM r),
b AS (SELECT *, 1 << (ascii(filter_order[step]) - 65) AS own,
  coalesce(list_sum(list_transform(string_split(filter_order[:step - 1], ''), lambda f: CASE WHEN f = '' THEN 0 ELSE 1 << (ascii(f) - 65) END)), 0)::INT AS earlier FROM s)
SELECT part, filter_order, step, {", ".join(_SUM.format(test=t, value=v, name=n) for t, v, n in [
    ("x.m & (own | earlier) = 0", "x.n", "kept"), (_REMOVED, "x.n", "removed"), ("x.m & own <> 0 AND x.m & earlier <> 0", "x.n", "redundant"), ("x.m = own", "x.n", "unique_fails"),
    (_REMOVED, "x.g", "good_lost"), (_REMOVED, "x.b", "toxic_lost"), ("x.m & own <> 0", "x.n * (120 // bit_count(x.m))", "shapley")])}
FROM b
"""


def brute_force(rows: list[tuple], labels: list[tuple]) -> dict[tuple[str, str, int], tuple[int, ...]]:
    """The same by running every order over all rows (key, text, part); labels are (key, quality, toxic). For tests."""
    import re

    least: dict[str, int] = {}
    for k, text, _ in rows:
        if k is not None:
            least[text or ""] = min(k, least.get(text or "", k))
    good, bad = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    judged = []
    for k, text, part in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), k is not None and k > least[text])
        judged.append((part or "", k, {f for f, t in zip(FILTERS, tests) if t}))
    out = {}
    for part in {p for p, _, _ in judged}:
        mine = [(k, fails) for p, k, fails in judged if p == part]
        total = dict.fromkeys(FILTERS, 0)
        for order in ORDERS:
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k, fails in left if f in fails]
                failing = sum(f in fails for _, fails in mine)
                left = [(k, fails) for k, fails in left if f not in fails]
                total[f] += len(gone)
                out[part, order, step] = (len(left), len(gone), failing - len(gone), sum(fails == {f} for _, fails in mine), sum(k in good for k in gone), sum(k in bad for k in gone))
        for (p, order, step), found in list(out.items()):
            if p == part:
                out[p, order, step] = (*found, total[order[step - 1]])
    return out
