"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets: sources in code-point order (null last) have the weights 5, 2, 1, repeating, and share
`share` times all sizes; a source stops at `cap` times its own size, and its excess goes to the others by
weight until none is above (water filling: with sources in order of size per weight, the level follows
from running sums over the sources).

Documents: with target t and source size S each document is due t / S copies. The whole part is certain and
allocated first. The rest is an inclusion probability p, and documents are ranked by random odds over
inclusion odds, (u / (1 - u)) / (p / (1 - p)), u being a hash of seed, doc_id and text; the lowest ranks
are taken until their words come as near to the remaining target as whole documents can. `preference`
(a positive column) makes the probabilities unequal within a source too.

A hot source is never ordered in one task: its ranks are cut into bins of equal probability, running sums over
(source, bin) find the one bin in which the target is reached, and only that bin is ordered.

Nulls and edges: a null text has size 0 and is taken whole or not at all, at 0 words; null sources are one
source; a null doc_id is hashed as null; repeated rows are drawn alike and share a rank, ordered
arbitrarily but indistinguishably; sources of size 0 have target 0; extra columns pass through `copies`; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import sized_broadcast, written

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> and target. One row per source, so windows over it are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    ranked = ranked.withColumn("below", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("above", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.col("below")) / F.col("above"))
    # in this order the first source that its level does not fill sets the level of all that follow
    ranked = ranked.withColumn("place", F.row_number().over(by_level))
    ranked = ranked.withColumn("first", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("place"))).over(all_rows))
    ranked = ranked.withColumn("final", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(all_rows))
    full = F.col("first").isNull() | (F.col("place") < F.col("first"))
    return ranked.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def _uniform(*of: Column) -> Column:
    """A uniform number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def decisions(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, per_bin: int = 2000, preference: str | None = None) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """The narrow table of sizes and draws of docs, the same columns before docs' own, and the function that
    adds _source_size, _target and _copies (0 to cap) to either."""
    u = _uniform(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = docs.withColumns({"_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "_u": u})
    liking = F.greatest(F.coalesce(F.col(preference).cast("double"), F.lit(0.0)), F.lit(0.0)) if preference else F.log(F.col("_size") + 2.0)
    sized = sized.withColumn("_liking", liking)
    narrow = written(sized.select("doc_id", "source", "_size", "_u", "_liking"), "sizes")
    sources = narrow.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n"), F.sum(F.col("_liking") * F.col("_size")).alias("liked"))
    sources = written(sources, "sources")
    goal = targets(sources.select("source", "source_size"), weights, share, cap).withColumnRenamed("source", "_of")
    goal = written(sources.join(goal.select("_of", "target"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of"), "targets")
    due = goal.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.ceil(F.col("n") / per_bin + 16).alias("_bins"), "liked")
    due = due.withColumn("_whole", F.when(F.col("_source_size") > 0, F.least(F.floor(F.col("_target") / F.col("_source_size")), F.lit(int(cap)))).otherwise(0).cast("long"))
    due = due.withColumn("_rest", F.col("_target") - F.col("_whole") * F.col("_source_size"))
    due = due.withColumn("_p", F.when(F.col("liked") > 0, F.col("_rest") / F.col("liked")).otherwise(0.0)).drop("liked")
    due = sized_broadcast(due)

    def ranked(df: DataFrame) -> DataFrame:
        df = df.join(due, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        p = F.greatest(F.least(F.col("_p") * F.col("_liking"), F.lit(1 - 1e-9)), F.lit(1e-12))
        df = df.withColumn("_rank", (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p)))
        # rank / (1 + rank) is monotone in the rank and lies in (0, 1)
        return df.withColumn("_bin", F.least(F.floor(F.col("_rank") / (1 + F.col("_rank")) * F.col("_bins")), F.col("_bins") - 1).cast("int"))

    rows = ranked(narrow)
    per_bin = rows.groupBy("source", "_bin", "_rest").agg(F.sum("_size").alias("_words"))
    running = Window.partitionBy("source").orderBy("_bin")
    per_bin = per_bin.withColumn("_before", F.sum("_words").over(running) - F.col("_words"))
    edge = written(per_bin.where("_before < _rest and _before + _words >= _rest").select(F.col("source").alias("_s"), F.col("_bin").alias("_edge"), "_before"), "edges")
    edge = sized_broadcast(edge)
    inside = rows.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_edge")))
    order = Window.partitionBy("source", "_bin").orderBy("_rank", "doc_id", "_size")
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the document that crosses the target is taken if that leaves the words nearer to it
    last = inside.where(F.col("_upto") - F.col("_size") / 2.0 <= F.col("_rest")).groupBy("source").agg(F.max("_rank").alias("_last"))
    cuts = edge.select("_s", "_edge").join(last, F.col("_s").eqNullSafe(F.col("source")), "left").select(F.col("_s").alias("_c"), "_edge", "_last")
    cuts = sized_broadcast(written(cuts, "cuts"))

    def decided(df: DataFrame) -> DataFrame:
        out = ranked(df).join(cuts, F.col("source").eqNullSafe(F.col("_c")), "left")
        upto_edge = F.when(F.col("_bin") < F.col("_edge"), True).when(F.col("_bin") > F.col("_edge"), False)
        extra = F.when(F.col("_rest") <= 0, False).when(F.col("_edge").isNull(), True).otherwise(F.coalesce(upto_edge, F.col("_rank") <= F.col("_last"), F.lit(False)))
        copies = F.least(F.col("_whole") + extra.cast("long"), F.lit(int(cap)))
        return out.withColumn("_copies", copies).select(*df.columns, "_source_size", "_target", "_copies")

    return narrow, sized, decided


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, taken."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    narrow, _, decided = decisions(rows, **options)
    return decided(narrow).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def copies(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as it is taken, with the columns of docs, which may have
    any names as they travel in one struct."""
    used = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")]
    if options.get("preference"):
        used.append(F.col(options["preference"]))
    _, sized, decided = decisions(docs.select(*used, F.struct("*").alias("_row")), **options)
    return decided(sized).where("_copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select("_row.*")
