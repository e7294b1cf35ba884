"""Document fingerprints: invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs are its lines, long ones cut every 100 code points; its digests are the distinct 64-bit
hashes of them. A sketch has three equal parts; a digest enters one cell of each part. A cell
holds the number of its digests, their exclusive or, and that of their checks. Sketches subtract cell by
cell, which leaves the digests that only one text has; a cell with one of those (its check tells) gives it
up, it is taken out of its other cells, and so on: peeling. If that ends with cells left, the comparison
is tried again with sketches four times as large, twice, and then on the digests themselves.

The fingerprint of a text is a list of sketches of 24 cells: its digests are dealt by hash into shards, a power of two of
them that keeps about five in each, so a longer text has more sketches. Cells of two shards add up, so
fingerprints of different numbers of shards are compared at the smaller number. The likeness is taken from these
fingerprints; only a shard that does not peel is tried again, larger, from its digests.
likeness = 1 - differing digests / all digests of both; 1 if both have none. A text's digests are sorted once and sliced
at the shards' borders, so the work is that of one sort and otherwise linear in the text.

The next document in doc_id order comes from a window within doc_id ranges (approximate quantiles, four per
shuffle partition), each range closed by a copy of the next range's first row, so no task sees all rows. A row finds
its range by a small table of even cells of the id space, which is broadcast (its size is that of the ranges).

Nulls and edges: a null text is empty; equal texts have equal fingerprints; null doc_ids come first; equal
doc_ids are ordered by text; a single document is its own next; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import written

PARAGRAPH = r"[^\n]{1,100}"
#: Bits of a cell number within a third of a sketch: 8, 32 and 128 cells a third.
SIZES = (3, 5, 7)
ROUNDS = 12


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))


def cell(i: Column, n: Column, k: Column, c: Column) -> Column:
    """A cell: its number in the sketch and its three sums."""
    return F.struct(i.cast("int").alias("i"), n.cast("int").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def combined(x: Column, n: Column, k: Column, c: Column) -> Column:
    return cell(x["i"], x["n"] + n, x["k"].bitwiseXOR(k), x["c"].bitwiseXOR(c))


def used(cells: Column) -> Column:
    return F.filter(cells, lambda x: (x["n"] != 0) | (x["k"] != 0))


def places(d: Column, bits: int) -> Column:
    """The three cells of a digest, one in each part."""
    mask = F.lit((1 << bits) - 1)
    return F.array(*(F.shiftright(d, t * bits).bitwiseAND(mask).cast("int") + (t << bits) for t in range(3)))


def sketch(of: Column, bits: int) -> Column:
    """All cells of an array of digests."""
    cells = F.array(*(cell(F.lit(i), F.lit(0), F.lit(0), F.lit(0)) for i in range(3 << bits)))
    keyed = F.transform(of, lambda d: F.struct(d.alias("k"), check(d).alias("c"), places(d, bits).alias("p")))
    return F.aggregate(keyed, cells, lambda acc, d: F.transform(acc, lambda x, i: F.when(F.get(d["p"], F.shiftright(i, bits)) == i, combined(x, F.lit(1), d["k"], d["c"])).otherwise(x)))


def difference(a: Column, b: Column, bits: int) -> Column:
    """The used cells of the sketch of a less that of b, from their digests: both are linear, so cells are summed once."""

    def entries(of: Column, sign: int) -> Column:
        return F.flatten(F.transform(of, lambda d: let(check(d), lambda c: F.transform(places(d, bits), lambda i: cell(i, F.lit(sign), d, c)))))

    def total(cells: Column) -> Column:
        return F.aggregate(F.slice(cells, 2, 1 << 30), F.get(cells, F.lit(0)), lambda x, y: combined(x, y["n"], y["k"], y["c"]))

    every = F.sort_array(F.concat(entries(a, 1), entries(b, -1)))
    return used(F.transform(F.filter(sliced(every, lambda x: x["i"]), lambda cells: F.size(cells) > 0), total))


def peel(cells: Column, bits: int) -> Column:
    """(found, left): digests recovered from the used cells of a difference, and whether cells were left."""
    start = let(cells, lambda x: F.struct(x.alias("cells"), F.lit(0).alias("found"), (F.size(x) > 0).alias("go")))

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (check(x["k"]) == x["c"]))
        ones = F.array_distinct(F.transform(pure, lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n"))))

        def remove(ones: Column) -> Column:
            keyed = F.transform(ones, lambda d: F.struct((-d["n"]).alias("n"), d["k"].alias("k"), check(d["k"]).alias("c"), places(d["k"], bits).alias("p")))
            less = lambda ds: F.transform(
                state["cells"], lambda x: F.aggregate(ds, x, lambda y, d: F.when(F.array_contains(d["p"], x["i"]), combined(y, d["n"], d["k"], d["c"])).otherwise(y))
            )
            return let(used(let(keyed, less)), lambda cells: F.struct(cells.alias("cells"), (state["found"] + F.size(ones)).alias("found"), ((F.size(ones) > 0) & (F.size(cells) > 0)).alias("go")))

        return F.when(state["go"], let(ones, remove)).otherwise(state)

    done = lambda s: F.struct(s["found"].alias("found"), (F.size(s["cells"]) > 0).alias("left"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, done)


def exactly(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def again(a: Column, b: Column, sizes: tuple[int, ...]) -> Column:
    """Digests that only one of two arrays has, by peeling sketches of growing sizes, at last by comparing."""
    if not sizes:
        return exactly(a, b)
    bits, *rest = sizes
    return let(peel(difference(a, b, bits), bits), lambda r: F.when(r["left"], again(a, b, tuple(rest))).otherwise(r["found"]))


def sliced(items: Column, key: Callable[[Column], Column]) -> Column:
    """An array sorted by key -> the arrays of equal keys."""

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (key(F.get(s, i - 1)) != key(F.get(s, i - 2))))
        return let(starts, lambda at: F.transform(at, lambda b, j: F.slice(s, b, F.coalesce(F.get(at, j + 1), F.size(s) + 1) - b)))

    return let(items, lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(F.array(F.slice(s, 1, 0))))


def shards(of: Column) -> Column:
    """Digests -> their number of shards and, for each shard in use, its number, cells and digests."""
    number = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.size(of) / F.lit(5.0))), F.lit(0))).cast("int")

    def build(n: Column) -> Column:
        placed = F.sort_array(F.transform(of, lambda d: F.struct(F.shiftright(d, 40).bitwiseAND((n - 1).cast("long")).alias("s"), d.alias("d"))))
        parts = F.transform(sliced(placed, lambda x: x["s"]), lambda part: let(F.transform(part, lambda x: x["d"]), lambda ds: F.struct(F.get(part, F.lit(0))["s"].alias("s"), sketch(ds, SIZES[0]).alias("cells"), ds.alias("of"))))
        return F.struct(n.alias("n"), F.filter(parts, lambda p: p["s"].isNotNull()).alias("parts"))

    return let(number, build)


def likeness(a: Column, b: Column) -> Column:
    """1 - differing / all, of two texts' shards."""
    size = lambda x: F.aggregate(x["parts"], F.lit(0), lambda n, p: n + F.size(p["of"]))
    total = size(a) + size(b)
    side = lambda x, n, sign: F.transform(x["parts"], lambda p: F.struct(p["s"].bitwiseAND((n - 1).cast("long")).alias("s"), F.lit(sign).alias("sign"), p["cells"].alias("cells"), p["of"].alias("of")))

    def shard(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))  # the sign of a whole difference does not matter: others are added to the first
        added = F.aggregate(F.slice(parts, 2, 1 << 30), first["cells"], lambda acc, p: F.zip_with(acc, p["cells"], lambda x, y: combined(x, y["n"] * p["sign"] * first["sign"], y["k"], y["c"])))
        digests_of = lambda sign: F.flatten(F.transform(F.filter(parts, lambda p: p["sign"] == sign), lambda p: p["of"]))
        return let(peel(used(added), SIZES[0]), lambda r: F.when(r["left"], let(F.struct(digests_of(1).alias("a"), digests_of(-1).alias("b")), lambda x: again(x["a"], x["b"], SIZES[1:]))).otherwise(r["found"]))

    def compare(n: Column) -> Column:
        both = F.sort_array(F.concat(side(a, n, 1), side(b, n, -1)))
        return F.aggregate(sliced(both, lambda x: x["s"]), F.lit(0), lambda acc, parts: acc + F.when(F.size(parts) > 0, shard(parts)).otherwise(0))

    return F.when(total == 0, 1.0).otherwise(1.0 - let(F.least(a["n"], b["n"]), compare) / total)


def printed(x: Column) -> Column:
    """The number of shards, then each shard in use with its used cells: number:cell.n.digests.checks,..."""
    shown = lambda cells: F.transform(used(cells), lambda c: F.concat_ws(".", c["i"].cast("string"), c["n"].cast("string"), F.hex(c["k"]), F.hex(c["c"])))
    return F.concat_ws(";", x["n"].cast("string"), F.transform(x["parts"], lambda p: F.concat(p["s"].cast("string"), F.lit(":"), F.concat_ws(",", shown(p["cells"])))))


def in_ranges(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """docs with grp: 1 + the number of bounds at or below doc_id; 1 for a null."""
    if not bounds:
        return docs.withColumn("grp", F.lit(1))
    spark, n, low, width = docs.sparkSession, len(bounds), float(bounds[0]), float(bounds[-1]) - float(bounds[0]) + 1
    even = lambda c: F.greatest(F.least(F.floor((c.cast("double") - low) / width * n), F.lit(n - 1)), F.lit(0)).cast("int")
    held = spark.createDataFrame([(b,) for b in bounds], "b long").groupBy(even(F.col("b")).alias("_cell")).agg(F.array_sort(F.collect_list("b")).alias("_within"))
    cells = spark.range(n).select(F.col("id").cast("int").alias("_cell")).join(held, "_cell", "left")
    below = F.coalesce(F.sum(F.size("_within")).over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_within", F.coalesce("_within", F.array().cast("array<bigint>"))).withColumn("_below", below)
    rows = docs.withColumn("_cell", F.coalesce(even(F.col("doc_id")), F.lit(0))).join(F.broadcast(cells), "_cell")
    grp = F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("_below") + F.size(F.filter("_within", lambda b: b <= F.col("doc_id"))) + 1)
    return rows.withColumn("grp", grp.cast("int")).drop("_cell", "_within", "_below")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, digests) -> with next_text and next_digests, the next row's in doc_id order."""
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    rows = in_ranges(docs, sorted(set(bounds or [])))
    firsts = written(rows.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("first")).select("grp", "first.doc_id"), "range-firsts")
    by_range = Window.orderBy("grp")  # one row per range
    before = firsts.withColumn("closes", F.coalesce(F.lag("grp").over(by_range), F.max("grp").over(Window.partitionBy())))
    before = before.select(F.col("grp").alias("_g"), F.col("doc_id").alias("_d"), "closes")
    heads = rows.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("grp") == F.col("_g")))
    one = Window.partitionBy("closes").orderBy("text")
    heads = heads.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("doc_id", "text", "digests", F.col("closes").alias("grp"), F.lit(1).alias("head"))
    both = rows.select("doc_id", "text", "digests", "grp", F.lit(0).alias("head")).unionByName(heads)
    order = Window.partitionBy("grp").orderBy("head", F.col("doc_id").asc_nulls_first(), "text")
    both = both.withColumn("next", F.lead(F.struct("text", "digests")).over(order))
    return both.where("head = 0").select("doc_id", "text", "digests", F.col("next.text").alias("next_text"), F.col("next.digests").alias("next_digests"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("digests", digests(F.col("text"))))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2)
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half.cast("int")))
    rows = rows.withColumn("edited", edited).withColumn("own", shards(F.col("digests"))).withColumn("next", shards(F.col("next_digests")))
    rows = rows.withColumn("edited_digests", digests(F.col("edited"))).withColumn("other", shards(F.col("edited_digests")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"),
        printed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
