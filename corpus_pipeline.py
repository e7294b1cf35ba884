"""The corpus pipeline: documents to packed training sequences, each stage a job of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import sized_broadcast, written
from wayfold.llm.jaccard_join import jaccard_components, text_classes
from wayfold.llm.mixing import copies
from wayfold.llm.packing import pack
from wayfold.llm.quality_fm import scores, train
from wayfold.llm.queries import BYTE_BPE, tokenizer_path
from wayfold.llm.secret_scan import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score 0.3 or more)."""
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "_".join([*docs.columns, "score"])  # no column has this name
    return scores(docs, machine, score).where(F.col(score) >= 0.3).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, of several rows with that doc_id the
    first by text. Rows with a null doc_id and wordless texts stay, as do unlinked texts that share a doc_id."""
    found = written(jaccard_components(docs), "near-copies")
    gone = written(found.where("group_smallest <> doc_id").select("doc_id").distinct(), "gone")
    shared = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared-ids")
    if shared.isEmpty():
        return docs.join(sized_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(sized_broadcast(gone.unionByName(shared).distinct()), "doc_id", "left_anti").select(*docs.columns)
    rows = docs.join(sized_broadcast(shared), "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    kept = found.where("group_smallest = doc_id").select("doc_id", F.col("text_class").alias("class"), "group_id").distinct()
    rows = text_classes(rows, "class").join(kept, ["doc_id", "class"])
    first = F.row_number().over(Window.partitionBy("doc_id", F.coalesce("group_id", F.xxhash64("text"))).orderBy("text"))
    return once.unionByName(rows.withColumn("place", first).where("place = 1").select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret masked in the text."""
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return copies(docs, weights=(5, 2, 1), share=1.5, cap=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack(docs, tokenizer_path(BYTE_BPE), end_id=1, length=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packing", packing),
]

#: The learnt stages cannot be said in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
