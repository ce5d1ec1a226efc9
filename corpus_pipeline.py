"""From web documents to token digests: filter, deduplicate, decontaminate, pseudonymise, encode.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``;
all but the last return the columns of ``docs``. ``run`` writes what a stage
returns as Parquet in the shared folder and gives it to the next. Rows without
a doc_id stay (no stage can name them), repeated rows share their fate, and
empty texts are judged like any other. Extra columns of ``docs`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellstrata.llm import bpe, decontaminate, jaccard, pii, quality
from cellstrata.llm.memory import batches_of
from cellstrata.plans.lineage import written

#: Ids up to this many are sent to every executor (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those whose doc_id is in ``ids``."""
    with batches_of(docs.sparkSession):
        ids = written(ids.distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels), into="__quality")
    with batches_of(spark):  # whole texts meet the model, so they are written here, from Arrow batches of bounded size
        return written(scored.where(F.col("__quality") >= quality.THRESHOLD).select(docs.columns), "good")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, keep the document of smallest doc_id."""
    groups = jaccard.join_groups(docs.select("doc_id", "text"))
    return without(docs, groups.where("component < id").select(F.col("id").alias("doc_id")))


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontaminate.find_leaks(docs, benchmark).select("doc_id").where("doc_id is not null"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms; ``n_chars`` follows the text."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    out = pii.pseudonymise(row, "demonstration key")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document; they are short, so they are written here, from Arrow batches of bounded size."""
    with batches_of(spark):
        return written(bpe.op2_byte_bpe(docs), "digests")


STAGES = [
    ("quality", keep_good),
    ("jaccard", keep_one_of_each_group),
    ("decontamination", keep_clean_of_benchmark),
    ("pii", pseudonymise),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
