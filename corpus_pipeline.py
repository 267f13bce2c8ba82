"""The corpus pipeline: five stages from raw documents to a weighted mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from quantloom.llm.common import scratch


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """docs with its own columns of an operator's names out of the way, and what selects all columns as they were."""
    clash = {n: f"__own_{n}" for n in names if n in docs.columns}
    return docs.withColumnsRenamed(clash), [F.col(clash.get(c, c)).alias(c) for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go.

    Null and empty texts are judged as one empty line, long texts whole, rows that repeat alike; other columns, of any name, stay as they are.
    Without labels every document stays. An empty table stays empty.
    """
    rows, back = _aside(docs, "held_out", "score", "predicted")
    scored = quality.with_score(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*back)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null texts count as empty; a null doc_id is below all; of rows that repeat doc_id and text one stays. Long texts are compared
    whole, other columns, of any name, stay as they are. An empty table stays empty.
    """
    return exact_dedup.keep_one(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the smallest doc_id stays.

    Texts without words (null, empty) and rows without a doc_id stay; rows that share the smallest doc_id all stay. Long texts are compared
    whole, other columns, of any name, stay as they are. An empty table stays empty.
    """
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go.

    Null and empty texts are clean and stay; long texts are scanned whole, rows that repeat are judged alike. Other columns, of any name,
    stay as they are. Without a benchmark every document stays. An empty table stays empty.
    """
    rows, back = _aside(docs, *decontaminate.OUTPUT)
    found = decontaminate.with_hits(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*back)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents with a word taken, and taken, their words repeats counted.

    Texts without words (null, empty) are never taken. A null source is one of its own; of rows with equal keys those with fewer words come
    first. Columns named size, source_size, target and taken are replaced, others stay. An empty table stays empty.
    """
    mixed = mixing.mix(docs, mixing.token_count(F.col("text")))
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    return mixed.where("taken > 0").select(*own, "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("near_dedup", near_deduplication),
    ("decontaminate", decontamination),
    ("mix_sources", source_mix),
]

#: The classifier and the sketches have no SQL form; the tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
