"""Table merges as DataFrame functions: each gives the table's new content, to be written over the touched partitions.
All are idempotent: merging the same source twice gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str] | None = None, keep_old: bool = False) -> DataFrame:
    """Insert or update. columns: those the source may set (all by default; an inserted row has nulls elsewhere);
    keep_old: a null of the source never erases a value."""
    names = target.columns
    columns = columns or [c for c in names if c not in keys]
    s = source.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns)).withColumn("_hit", F.lit(True))
    joined = target.join(s, keys, "full_outer")

    def value(c: str):
        if c not in columns:
            return F.col(c)
        new = F.coalesce(f"_{c}", c) if keep_old else F.col(f"_{c}")
        return F.when(F.col("_hit"), new).otherwise(F.col(c)).alias(c)

    return joined.select(*(F.col(c) if c in keys else value(c) for c in names))


def replace_scope(target: DataFrame, source: DataFrame, scope: list[str]) -> DataFrame:
    """Delete the target's rows whose scope occurs in the source, then insert the source."""
    return target.join(source.select(*scope).distinct(), scope, "left_anti").unionByName(source.select(*target.columns))


def guarded_insert(target: DataFrame, source: DataFrame, keys: list[str], parents: DataFrame, parent: str) -> DataFrame:
    """Insert the source's rows that have a parent and are not there yet."""
    new = source.join(parents.select(parent), parent, "left_semi").dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resume(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def appended(old: DataFrame, new: DataFrame, key: str, values: str, order: str, scalars: list[str] | None = None) -> DataFrame:
    """Array union by key, first appearances first: those of the old array, then new ones by their first order. scalars: columns that
    the last new value that is not null sets, and that stay where there is none."""
    first = new.where(F.col(values).isNotNull()).groupBy(key, values).agg(F.min(order).alias("_at"))
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", values))), lambda x: x[values]).alias("_new"))
    scalars = scalars or []
    set_ = new.groupBy(key).agg(F.count("*").alias("_n"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in scalars))
    kind = old.schema[values].dataType.simpleString()
    empty = F.array().cast(kind)
    joined = old.join(lists, key, "left").join(set_, key, "left")
    out = joined.withColumn(values, F.array_distinct(F.concat(F.coalesce(values, empty), F.coalesce("_new", empty))))
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in scalars}).select(*old.columns)


def hit(cache: DataFrame, requests: DataFrame, key: str, counter: str) -> DataFrame:
    """The cache's rows with their counter raised by the requests of their key; requests of unknown keys change nothing."""
    asked = requests.groupBy(key).agg(F.count("*").alias("_asked"))
    return cache.join(asked, key, "left").withColumn(counter, F.col(counter) + F.coalesce("_asked", F.lit(0))).select(*cache.columns)
