"""Secret scan with multipart linking, in DataFrame functions only.

Strong findings (assignments, access identifiers, long hex runs) are reported as they are. Weak parts (user names, token-like words,
endpoints) are reported only if a complementary part lies in the same scope: an identifier needs a secret, a secret needs an
identifier or an endpoint, an endpoint needs a secret. A scope is a block of text between blank lines; parts link over at most
``reach`` code points. Linking is an interval join: every part offers itself to the buckets of ``reach`` code points that it or its reach
touches, a weak part looks up every bucket of its own span, and a semi-join stops at the first partner, so no pairs arise.

Start positions come from the gaps between matches: ``split`` returns the gaps, and a running sum of gap and match lengths per
document and kind gives code-point positions in time linear in the number of matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from drygrid.llm.common import TAG, null_safe, row_tag, written

#: Kinds in the order in which equal starts are listed: name, pattern, group whose value is judged. Fixed values.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", r"AKIA[A-Z0-9]{14,}", 0),
    ("hex", r"[0-9a-f]{16,}", 0),
    ("identifier", r"""(?i)(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", 0),
    ("secret", r"[A-Za-z0-9+/_-]{20,}={0,2}", 0),
    ("endpoint", r"""(?i)(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>|]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])""", 0),
    ("break", r"\n[\x20\t\r]*\n\s*", 0),
)
BASE = 3
NEEDS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}


def _good(name: str, match: Column, value: Column) -> Column:
    if name == "assign":
        return F.length(value) >= 12
    if name == "secret":
        return match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return F.lit(True)


def _matches(text: Column, order: int) -> Column:
    """Array of (kind, number, length of the gap before, length, good) of all matches of one kind."""
    name, pattern, group = KINDS[order]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(found, values, F.split(text, pattern, -1))
    listed = F.transform(zipped, lambda x, i: F.struct(
        F.lit(order).alias("kind"), i.alias("number"), F.length(x["2"]).alias("gap"), F.coalesce(F.length(x["0"]), F.lit(0)).alias("size"),
        (x["0"].isNotNull() & _good(name, x["0"], x["1"])).alias("good")))
    return F.when(text.rlike(pattern), listed)


def _role(kind: Column, size: Column) -> Column:
    """What a part can complement: access identifiers and names identify, assignments, long hex runs and tokens are secrets."""
    return (F.when(kind.isin(1, 3), "identifier").when(kind.isin(0, 4) | ((kind == 2) & (size >= 32)), "secret").when(kind == 5, "endpoint"))


def find_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = 200) -> DataFrame:
    """Rows key, ``_row_tag``, ``kind`` (number in ``KINDS``), ``start``, ``end`` (code points, end exclusive) of all reported spans.

    NULL or empty texts have none; repeated rows (same key and text) give their spans once. A weak span may overlap a strong one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    arrays = [F.coalesce(_matches(body, k), F.array().cast("array<struct<kind:int,number:int,gap:int,size:int,good:boolean>>")) for k in range(len(KINDS) - 1)]
    rows = docs.select(F.col(key).alias("_key"), row_tag(text).alias(TAG), body.alias("_text"), F.concat(*arrays).alias("_parts"))
    scopes = F.when(F.exists("_parts", lambda p: p["kind"] >= BASE), _matches(F.col("_text"), len(KINDS) - 1))
    empty = F.array().cast("array<struct<kind:int,number:int,gap:int,size:int,good:boolean>>")
    parts = rows.filter(F.size("_parts") > 0).select("_key", TAG, F.inline(F.concat("_parts", F.coalesce(scopes, empty))))
    # Repeated rows collapse on the map side before anything is spread by document.
    once = parts.groupBy("_key", TAG, "kind", "number").agg(F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("good").alias("good")).repartition("_key", TAG)
    along = Window.partitionBy("_key", TAG, "kind").orderBy("number")
    placed = once.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(along)).filter("good").select(
        "_key", TAG, "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    breaks = F.sum((F.col("kind") == len(KINDS) - 1).cast("long")).over(Window.partitionBy("_key", TAG).orderBy("start", "kind"))
    spans = placed.withColumn("scope", breaks).filter(F.col("kind") < len(KINDS) - 1).withColumn("role", _role(F.col("kind"), F.col("end") - F.col("start")))
    spans = written(spans)  # small, and texts are scanned once

    offers = spans.filter("role is not null").select(
        F.col("_key").alias("k"), F.col(TAG).alias("t"), F.col("scope").alias("s"), F.col("role").alias("r"), F.col("start").alias("a"), F.col("end").alias("b"),
        F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))).alias("bucket"))
    weak = spans.filter(F.col("kind") >= BASE).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))))
    complementary = F.lit(False)
    for role, needs in NEEDS.items():
        complementary = complementary | ((weak["role"] == role) & offers["r"].isin(*needs))
    linked = weak.join(offers, weak["_key"].eqNullSafe(offers["k"]) & (weak[TAG] == offers["t"]) & (weak["scope"] == offers["s"]) & (weak["bucket"] == offers["bucket"])
                       & complementary & (F.greatest(weak["start"] - offers["b"], offers["a"] - weak["end"]) <= reach), "left_semi")
    keep = ["_key", TAG, "kind", "start", "end"]
    return spans.filter(F.col("kind") < BASE).select(*keep).unionByName(linked.select(*keep).distinct())


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = 200) -> DataFrame:
    """One row per row of ``docs``: key, counts of strong kinds, ``base_spans`` and ``spans`` as text. Documents without spans have '' and 0."""
    span = F.struct("start", "kind", "end")
    found = find_spans(docs, text, key, reach).groupBy("_key", TAG).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        _joined(F.collect_list(F.when(F.col("kind") < BASE, span))).alias("base_spans"), _joined(F.collect_list(span)).alias("spans"))
    rows = docs.select(F.col(key).alias("_key"), row_tag(text).alias(TAG))
    out = null_safe(rows, found, ("_key", TAG))
    return out.select(F.col("_key").alias(key), *[F.coalesce(f"n_{KINDS[k][0]}", F.lit(0)).cast("long").alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
                      F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"))


def op4(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return secret_report(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """Counts and joined strong spans of one text; for tests."""
    patterns = (
        ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))
    spans, counts = [], []
    for order, (name, pattern, group, least) in enumerate(patterns):
        hits = [m for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
        counts.append(len(hits))
        spans += [(m.start(), order, f"{name}:{m.start()}:{m.end()}") for m in hits]
    return (*counts, ",".join(s[2] for s in sorted(spans)))


def brute_force_linked(text: str | None, reach: int = 200) -> set[tuple[str, int, int]]:
    """Weak spans (kind, start, end) that are reported, from all pairs of parts; for tests."""
    parts = []
    for order, (name, pattern, group) in enumerate(KINDS):
        for m in re.finditer(pattern, text or "", re.ASCII):
            size = m.end() - m.start()
            if name == "assign" and len(m.group(group)) < 12 or name == "secret" and not all(re.search(c, m.group()) for c in ("[0-9]", "[a-z]", "[A-Z]")):
                continue
            role = {0: "secret", 1: "identifier", 2: "secret" if size >= 32 else None, 3: "identifier", 4: "secret", 5: "endpoint"}.get(order)
            parts.append((m.start(), m.end(), order, role))
    breaks = [a for a, _, order, _ in parts if order == len(KINDS) - 1]
    weak = [p for p in parts if BASE <= p[2] < len(KINDS) - 1]
    return {(KINDS[o][0], a, b) for a, b, o, r in weak for c, d, _, q in parts
            if q in NEEDS[r] and max(a - d, c - b) <= reach and not any(min(a, c) < x <= max(a, c) for x in breaks)}
