"""What the shown candidates that were picked tell, and whether enough were shown to trust it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank_histogram(shown: DataFrame, picked: str = "picked", rank: str = "rank") -> DataFrame:
    """rank, n of the picked candidates; ranks that are null or 0 are left out."""
    return shown.where(F.col(picked) & (F.col(rank) > 0)).groupBy(F.col(rank).alias("rank")).agg(F.count("*").alias("n"))


def term_gaps(shown: DataFrame, terms: list[str], picked: str = "picked") -> DataFrame:
    """term, picked_mean, passed_mean, samples for each term that has values on both sides; a null term counts on neither. One aggregate
    of fixed width, then one row a term."""
    yes, no = F.col(picked), ~F.col(picked)
    sides = [f(F.when(side, F.col(t))).alias(f"{name}_{i}") for i, t in enumerate(terms) for name, f, side in (("a", F.avg, yes), ("b", F.avg, no), ("n", F.count, yes), ("m", F.count, no))]
    rows = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"a_{i}").alias("picked_mean"), F.col(f"b_{i}").alias("passed_mean"), (F.col(f"n_{i}") + F.col(f"m_{i}")).alias("samples")) for i, t in enumerate(terms)))
    return shown.agg(*sides).select(F.inline(rows)).where("picked_mean is not null and passed_mean is not null")


def verdict(shown: DataFrame, picked: str = "picked", rank: str = "rank", samples: int = 200, bias: float = 0.7) -> DataFrame:
    """One row: picked, passed, top2_share of the ranked picks (0 without any), and the verdict: `few` below samples shown, `biased` where
    the first two ranks hold bias or more of the picks, else `ok`."""
    yes = F.coalesce(F.col(picked), F.lit(False))
    one = shown.agg(F.count_if(yes).alias("picked"), F.count_if(~yes).alias("passed"), F.count_if(yes & (F.col(rank) > 0)).alias("_ranked"), F.count_if(yes & F.col(rank).isin(1, 2)).alias("_top"))
    share = F.coalesce(F.try_divide("_top", "_ranked"), F.lit(0.0))
    told = F.when(F.col("picked") + F.col("passed") < samples, "few").when(share >= bias, "biased").otherwise("ok")
    return one.select("picked", "passed", share.alias("top2_share"), told.alias("verdict"))
