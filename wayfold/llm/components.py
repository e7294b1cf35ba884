"""Connected components by contraction: every node hooks to its smallest neighbour, pointers are halved, and
the links are rewritten between the remaining roots until none is left. Each round is a few joins over
written tables, so hot nodes are ordinary skewed joins that adaptive execution can split, and a lost
executor costs only running tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import written


def _mapped(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """Replace column by its root where it has one."""
    other = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return df.join(other, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_r", column)).drop("_n", "_r")


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, root): for every node of a link the smallest node reachable from it.
    Null ends and links of a node to itself are ignored; repeated links count once; no link gives no row."""
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = written(links.where("a < b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        roots = written(roots, "roots")
        while True:
            jumped = written(_mapped(roots.withColumn("was", F.col("root")), "root", roots), "roots")
            roots = jumped.select("node", "root")
            if jumped.where("root <> was").isEmpty():
                break
        if labels is None:
            labels = roots
        else:
            labels = _mapped(labels, "root", roots)
            labels = written(labels, "labels")
        links = _mapped(_mapped(links, "a", roots), "b", roots)
        links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        links = written(links, "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
