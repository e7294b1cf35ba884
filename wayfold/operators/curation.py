"""Curation of places and reviews: labels, duplicates, quotas, tiers, relevance, quality, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold import constants as K
from wayfold.functions.columns import bounded_name, clean_html, normalised
from wayfold.operators.quantiles import quantiles


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def same_entities(places: DataFrame) -> DataFrame:
    """Places (poi_id, name, lat, lng, category) of one normalised name, category and point at six decimals are one: the first
    poi_id, and how many there were. An aggregate, so that a name of many branches is counted before it is dealt."""
    return places.groupBy(normalised(F.col("name")).alias("name"), F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "category").agg(F.min("poi_id").alias("poi_id"), F.count("*").alias("n"))


def duplicate_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number and how many rows could go."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("removable", F.col("n") - 1)


def labelled_exclusion(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, or null."""
    out: Column | None = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out


def quotas(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Largest remainders: keys, n, quota. The window runs over groups, not rows."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    groups = groups.withColumn("raw", F.col("n") / F.sum("n").over(everything) * total).withColumn("base", F.floor("raw"))
    missing = F.lit(total) - F.sum("base").over(everything)
    place = F.row_number().over(Window.orderBy(F.round(F.col("raw") - F.col("base"), 9).desc(), *keys))
    return groups.withColumn("quota", F.col("base") + (place <= missing).cast("long")).select(*keys, "n", "quota")


def top_by_quota(rows: DataFrame, quota: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.join(quota.select(*keys, "quota"), keys).withColumn("place", F.row_number().over(w)).where("place <= quota")


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum by a seeded hash of their key; a stratum with fewer is an error."""
    least = rows.groupBy(stratum).agg(F.count("*").alias("_held"))
    least = least.select(F.col(stratum), F.when(F.col("_held") >= n, F.col("_held")).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {n} rows in stratum "), F.coalesce(F.col(stratum).cast("string"), F.lit("null")))).cast("bigint")).alias("_held"))
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(seed), key), 256), key)
    drawn = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return drawn.join(least.withColumnRenamed(stratum, "_s"), F.col(stratum).eqNullSafe(F.col("_s"))).where("_held > 0").drop("_s", "_held")


RUN = 3


def containing(documents: DataFrame, quotes: DataFrame, key: str, item: str) -> DataFrame:
    """documents (key, text) that contain quotes (item, quote): pairs (key, item).

    The inner words of a quote, all but the first and last, stand in a containing text as whole words between single spaces. So a text that
    contains it has one of its runs of RUN inner words among its own runs: pairs meet by the hash of the quote's first such run, and only
    they are searched. Quotes of fewer inner words have no run and are searched for in every text, one pass for all of them."""
    words = lambda text: F.split(text, " ", -1)
    inner = quotes.where("quote is not null").withColumn("_w", words(F.col("quote"))).withColumn("_long", F.size("_w") >= RUN + 2)
    run = F.xxhash64(F.array_join(F.slice("_w", 2, RUN), " "))
    asked = inner.where("_long").select(item, "quote", run.alias("_run"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - RUN + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(F.col("_w"), i, RUN), " ")))
    texts = documents.where("text is not null").select(key, words(F.col("text")).alias("_w")).select(key, F.explode(F.array_distinct(runs)).alias("_run"))
    met = texts.join(asked.select(item, "_run"), "_run").select(key, item).distinct()
    found = met.join(documents.select(key, "text"), key).join(quotes.select(item, "quote"), item).where(F.contains("text", "quote")).select(key, item).distinct()
    short = inner.where("not _long").select(item, "quote")
    if short.isEmpty():
        return found
    rest = documents.select(key, "text").join(short, F.contains("text", "quote")).select(key, item)
    return found.unionByName(rest)


def relevance(name: Column, title: Column, body: Column, places: Column, boundaries: bool = True) -> Column:
    """Title name 3 or body name 1 (else 0 in all), title place 2 or body place 1."""
    if boundaries:
        has = lambda text: F.regexp_like(F.lower(clean_html(text)), bounded_name(name))
    else:
        has = lambda text: F.contains(normalised(text), normalised(name))
    near = lambda text: F.exists(places, lambda p: F.contains(normalised(text), normalised(p)))
    named = F.when(has(title), 3).when(has(body), 1).otherwise(0)
    placed = F.when(near(title), 2).when(near(body), 1).otherwise(0)
    return F.when((named == 0) | (normalised(name) == ""), 0).otherwise(named + placed)


def round_robin(rows: DataFrame, key: str, lane: str, rank: str, item: str, cap: int) -> DataFrame:
    """Merge ranked lanes of a key in turn, each item once (its first place), at most cap."""
    first = rows.groupBy(key, item).agg(F.min(F.struct(F.col(rank).alias("r"), F.col(lane).alias("l"))).alias("at"))
    w = Window.partitionBy(key).orderBy("at")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap).select(key, item, "place")


def quality(places: DataFrame, prior: float = K.QUALITY_PRIOR) -> DataFrame:
    """places (poi_id, sentiment, mentions, clean) -> quality: prior-weighted sentiment times capped, logged mentions.
    The mean and the 95th percentile are one row each."""
    m = F.coalesce("mentions", F.lit(0))
    whole = places.agg(F.avg("sentiment").alias("m")).crossJoin(quantiles(places, [], m, {"p95": 0.95}))
    mean = (prior * F.col("m") + F.coalesce("sentiment", "m") * F.col("clean")) / (prior + F.col("clean"))
    heard = F.log1p(F.least(m, F.col("p95"))) / F.log1p("p95")
    return places.crossJoin(F.broadcast(whole)).withColumn("quality", F.least(F.greatest(mean * heard, F.lit(0.0)), F.lit(1.0))).drop("m", "p95")


def valid_attributes(rows: DataFrame, vocabulary: tuple[str, ...], most: int = 3) -> DataFrame:
    """rows (tags, relevant array<boolean>, sponsored array<boolean>, chosen array<int>, sentiment): tags of the vocabulary
    only; parallel arrays of unequal length count as no reviews; sentiment needs a clean relevant review; the first
    `most` distinct chosen indices of relevant reviews stay."""
    n = F.when(F.size("relevant") == F.size("sponsored"), F.size("relevant")).otherwise(0)
    clean = F.when(n > 0, F.size(F.filter(F.arrays_zip("relevant", "sponsored"), lambda x: x["relevant"] & ~x["sponsored"]))).otherwise(0)
    vocab = F.array(*map(F.lit, vocabulary))
    valid = F.filter(F.array_distinct("chosen"), lambda i: (i >= 0) & (i < n) & F.coalesce(F.get("relevant", i), F.lit(False)))
    return rows.select("*", F.array_intersect("tags", vocab).alias("valid_tags"), clean.cast("long").alias("clean"), F.slice(valid, 1, most).alias("valid_chosen"), F.when(clean > 0, F.col("sentiment")).alias("valid_sentiment"))
