"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm.importance_sql import resampled_sql
from wayfold.llm.turn_repair_sql import repair_sql

#: Names of the public tokenizer files; tokenizer_path turns them into paths.
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
RANK_BPE = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.token_files import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), end_id=0)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), size=5, percent=80)


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.recompress import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), size=50)


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.quality_fm import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), end_id=1, length=2048)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.bpe_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE), limit=4096)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.iblt import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.turn_repair import repair

    return repair(table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.importance import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, percent=25, least_words=20, seed=7)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.llm.rank_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(RANK_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_jaccard_join,
        op3_recompression,
        op4_quality_fm,
        op5_packing,
        op6_secret_scan,
        op7_mixing,
        op8_token_counts,
        op9_fingerprints,
        op10_embedding_dedup,
        op11_turn_repair,
        op12_importance_resampling,
        op13_byte_bpe,
    )
}

#: The full results of the others cannot be said in SQL; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {"op11_turn_repair": repair_sql(), "op12_importance_resampling": resampled_sql()}
