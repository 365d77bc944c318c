"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from drygrid.llm import containment, factorisation, line_alignment, packing, setsketch
from drygrid.llm.common import written

SIMILARITY = 80


def _aside(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` with its own columns of these names out of the way of an operator's."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in names if c in docs.columns})


def _own(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, those set aside under their names again."""
    return found.select(*[F.col(f"_own_{c}" if f"_own_{c}" in found.columns else c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, learnt from the labels of these documents, takes for good. A column ``score`` of ``docs`` stays as it is."""
    scored = factorisation.quality(_aside(docs, ("score",)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _own(scored.filter(F.col("score") >= factorisation.THRESHOLD), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove blocks of lines that an earlier document has; a document that loses all its lines goes.

    Columns ``n_lines`` and ``n_removed`` of ``docs`` stay as they are.
    """
    found = line_alignment.line_dedup(_aside(docs, ("n_lines", "n_removed")))
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return _own(left.withColumn("n_chars", size), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return setsketch.keep_one(docs, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain an item of the benchmark."""
    return containment.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the rest into sequences: a row for each piece."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("best-fit packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if number < len(STAGES) else docs
    return docs
