"""Scoring and ranking of candidates, the shown set, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold import constants as K
from wayfold.functions import scoring as S
from wayfold.functions.columns import resistance


def with_reference(candidates: DataFrame) -> DataFrame:
    """affinity_ref: median of the positive affinities of a request's candidate rows (null if there is none). A window
    over the request's few candidates, so that they are built once and share their shuffle with the ranking."""
    return candidates.withColumn("affinity_ref", F.median(F.when(F.col("affinity") > 0, F.col("affinity"))).over(Window.partitionBy("request_id")))


def scored(candidates: DataFrame) -> DataFrame:
    """Terms, base, penalty and score. Expects affinity, affinity_ref, similarity, rate, level next to request and place."""
    c = F.col
    tags = F.array_compact(F.array("tag1", "tag2"))
    terms = {
        "segment_affinity": S.segment_term(c("affinity"), c("affinity_ref")),
        "purpose_match": S.purpose_match(tags, c("purpose")),
        "taste_similarity": S.taste_term(c("similarity")),
        "context_fit": S.context_fit(c("exposure"), c("rain"), c("pm"), c("feels"), c("hour"), c("sunset"), c("sensitivity")),
        "quality": S.quality_term(c("quality")),
        "live_segment_match": S.live_match(c("rate"), c("age_band")),
        "crowd_fit": S.crowd_fit(c("level"), c("purpose")),
    }
    out = candidates.withColumns(terms)
    out = out.withColumn("base", S.renormalised({n: c(n) for n in terms}))
    out = out.withColumn("penalty", S.distance_penalty(c("dist") * resistance(c("u_zone"), c("zone")), c("rain")))
    return out.withColumn("score", S.total_score(c("base"), c("penalty")))


def top(scored_rows: DataFrame, n: int = K.TOP_N) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "poi_id")
    return scored_rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def shown(ranked: DataFrame, limit: int = K.SHOWN) -> DataFrame:
    """ranked (request_id, poi_id, rank, score, pick: place in the explanation or null): the picks in their order, filled
    up by rank to limit, then in rank order."""
    w = Window.partitionBy("request_id").orderBy(F.col("pick").asc_nulls_last(), "rank")
    chosen = ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("rank"))).drop("_n")


def exploration(ranked: DataFrame, seed: Column, lo: int = 6, hi: int = 20) -> DataFrame:
    """One of the ranks lo..hi of each request, by a hash of seed."""
    pool = ranked.where(F.col("rank").between(lo, hi))
    w = Window.partitionBy("request_id")
    pick = F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long"), F.col("_size"))
    pool = pool.withColumn("_size", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("rank")) - 1)
    return pool.where(F.col("_i") == pick).drop("_size", "_i")


def reason() -> Column:
    """Up to five ordered clauses, or a default sentence."""
    clauses = F.array_compact(
        F.array(
            F.when(F.get(F.array_compact(F.array("tag1", "tag2")), F.lit(0)) == F.col("purpose"), F.concat(F.col("purpose"), F.lit(" fits"))),
            F.when((F.col("rain") > 0.5) & (F.col("exposure") <= 0.3), F.lit("indoors in the rain")),
            F.when(F.col("quality") >= 0.7, F.lit("well reviewed")),
            F.when(F.col("dist") <= 500, F.lit("a short walk")),
            F.when(F.col("price") <= F.col("budget"), F.lit("within budget")),
        )
    )
    return F.when(F.size(clauses) == 0, "A good match nearby").otherwise(F.concat_ws(". ", clauses))
