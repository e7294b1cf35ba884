"""Near-duplicate embeddings by sorted projection passes.

Equal vectors of a label are folded to one with a multiplicity first. Each pass orders the vectors of a label lexicographically by the signs of 62 random projections (as one
integer) and compares every vector with the next `window` in that order; pairs at the threshold are
joined. All passes run as one sort: rows (pass, label, dimension, key) get a global position
from range partitions and per-partition offsets, and are dealt into chunks of fixed length, each with the first
`window` rows of the next, so that chunks are even whatever the labels' sizes. The passes carry (key, id)
only; a chunk's vectors join it as given, by id. A chunk returns a spanning
forest of its links, not the links, so a group of n near copies costs n rows a pass.
Then components: within each, every vector is compared with every other, in blocks, and only its number of links
is kept, which is quadratic in the distinct vectors of a component as the exact count is. That counts links exactly for all vectors whose component was found whole; a pair is missed
only if no chain of compared pairs joins it (recall is measured against brute force in the tests).
The share of pairs that meet in a round of passes falls as a label grows, so rounds with new projections
follow until one joins no two components. Labels of at most `window` + 1 vectors are compared whole by the first
round and need no other.

Nulls and edges: null, zero, empty or non-finite vectors, null components, null labels and null vec_ids
link with nothing (component_id is their own vec_id); vectors of different length link with nothing; labels may have
any type that casts to a string; repeated vec_ids tie the components of their vectors, and each row has the links of its own vector, copies of
which are other vectors; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import part_offsets, sized_broadcast, small_batches, written
from wayfold.llm.components import components


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, rid (64-bit hash of label and vector, null for those that link with nothing), label, dim, v (as given)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(F.col("label").cast("string")).alias("label"), F.col("label").isNotNull().alias("labelled"), v.alias("v"), F.size(v).alias("dim"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("labelled") & (F.col("dim") > 0) & finite & F.exists("v", lambda x: x != 0)
    return rows.select("vec_id", F.when(ok, F.xxhash64("label", "v")).alias("rid"), "label", "dim", "v")


def _unit(v: pa.Array, dim: int) -> np.ndarray:
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very small or large vectors keep their norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keyed(rows: DataFrame, passes: int, seed: list[int]) -> DataFrame:
    """Each row's id once a pass, with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(61, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([*seed, dim]).normal(size=(dim, passes * 62))
                signs = (_unit(own.column(2), dim) @ planes[dim] > 0).reshape(-1, passes, 62)
                key = (signs * weight).sum(2)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, p, np.int32)), own.column(0), own.column(1), own.column(3), pa.array(key[:, p])], names=["pass", "vec_id", "label", "dim", "key"])

    return rows.select("vec_id", "label", "v", "dim").mapInArrow(run, "pass int, vec_id long, label long, dim int, key long")


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, their place in a global order: ranges, places within them, and the ranges' offsets."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], names=[*b.schema.names, "part", "at"])
            at += b.num_rows

    placed = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "positions")
    bases = part_offsets(placed.groupBy("part").agg(F.count("*").alias("total")))
    return placed.join(F.broadcast(bases), "part").withColumn("pos", F.col("base") + F.col("at")).drop("part", "at", "base")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The pairs of (a, b) that join something new, over n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            out.append((x, y))
    return out


def window_links(placed: DataFrame, rows: DataFrame, window: int, chunk: int, threshold: float) -> DataFrame:
    """Spanning links (a, b) of the pairs at the threshold within the windows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        group = np.stack([table[c].to_numpy() for c in ("pass", "label", "dim")])
        ids, out = table["vec_id"].to_numpy(), []
        cuts = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0), [True]]))
        vectors = table["v"].combine_chunks()
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            x = _unit(vectors.slice(lo, hi - lo), int(group[2, lo]))
            a, b = [], []
            for step in range(1, min(window, hi - lo - 1) + 1):
                i = np.flatnonzero(np.einsum("ij,ij->i", x[:-step], x[step:]) >= threshold)
                a.append(i)
                b.append(i + step)
            if a:
                out += [(ids[lo + i], ids[lo + j]) for i, j in forest(np.concatenate(a), np.concatenate(b), hi - lo)]
        return pa.table({"a": pa.array([int(x) for x, _ in out], pa.int64()), "b": pa.array([int(y) for _, y in out], pa.int64())})

    pos = F.col("pos")
    chunks = F.when((pos >= chunk) & (pos % chunk < window), F.array(F.floor(pos / chunk), F.floor(pos / chunk) - 1)).otherwise(F.array(F.floor(pos / chunk)))
    dealt = placed.withColumn("chunk", F.explode(chunks)).select("chunk", "pos", "pass", "label", "dim", "vec_id")
    return dealt.join(rows.select("vec_id", "v"), "vec_id").groupBy("chunk").applyInArrow(run, "a long, b long")


def link_counts(members: DataFrame, block: int, threshold: float) -> DataFrame:
    """members (vec_id, root, label, dim, v, copies) -> (vec_id, n_links): links within each root's members, copies
    counted. Members are dealt into blocks by a hash and blocks meet in pairs; only counts leave a task."""
    sizes = written(members.groupBy("root").agg(F.count("*").alias("n")), "sizes").select(F.col("root").alias("of"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, F.col("root") == F.col("of")).drop("of")
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))

    def run(table: pa.Table) -> pa.Table:
        ids, own = table["vec_id"].to_numpy(), table["own"].to_numpy()
        kind = np.stack([table["label"].to_numpy(), table["dim"].to_numpy()])
        copies = table["copies"].to_numpy()
        same = own[0] == own[-1] and (own == own[0]).all() and table["x"][0].as_py() == table["y"][0].as_py()
        total = np.zeros(len(ids), np.int64)
        for label, dim in {tuple(k) for k in kind.T.tolist()}:
            at = np.flatnonzero((kind[0] == label) & (kind[1] == dim))
            x = _unit(table["v"].combine_chunks().take(pa.array(at)), dim)
            if same:
                total[at] += (x @ x.T >= threshold) @ copies[at] - 1
            else:
                p = own[at] == table["x"][0].as_py()
                linked = x[p] @ x[~p].T >= threshold
                total[at[p]] += linked @ copies[at[~p]]
                total[at[~p]] += copies[at[p]] @ linked
        return pa.table({"vec_id": ids, "n_links": total})

    # a block meets itself once, and another block as the pair (x, y)
    found = dealt.groupBy("root", "x", "y").applyInArrow(lambda t: run(t), "vec_id long, n_links long")
    return found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))


def linked(rows: DataFrame, threshold: float, passes: int, window: int, chunk: int, seed: int) -> DataFrame:
    """usable rows -> (node, root) of the components of their links: rounds of passes until one joins nothing new."""
    sizes = written(rows.groupBy("label", "dim").agg(F.count("*").alias("n")), "sizes").where(F.col("n") > window + 1)
    large = sized_broadcast(written(sizes.select("label", "dim"), "large"))
    found, left, turn = None, 0, 0
    while True:
        some = rows if found is None else rows.join(large, ["label", "dim"], "left_semi")
        placed = positions(keyed(some, passes, [seed, turn] if turn else [seed]), ["pass", "label", "dim", "key", "vec_id"])
        links = written(window_links(placed, some, window, chunk, threshold), "links")
        if found is not None:
            links = links.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = written(components(links), "components")
        # every join of two components, or of a new node, takes one off nodes less roots
        joins = found.where("node <> root").count()
        if joins == left or not turn and large.isEmpty():
            return found
        left, turn = joins, turn + 1


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, passes: int = 8, window: int = 50, chunk: int = 2000, block: int = 1024, seed: int = 1) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept, one row per row."""
    small_batches(vectors.sparkSession)
    rows = usable(vectors)
    folded = rows.where("rid is not null").groupBy(F.col("rid").alias("vec_id")).agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("v").alias("v"), F.count("*").alias("copies"))
    folded = written(folded, "distinct-vectors")
    found = linked(folded, threshold, passes, window, chunk, seed)
    placed = folded.join(found, folded["vec_id"] == found["node"], "left").withColumn("root", F.coalesce("root", "vec_id"))
    counts = link_counts(placed.where("node is not null or copies > 1").drop("node"), block, threshold)
    known = written(placed.select("vec_id", "root").join(counts, "vec_id", "left").select(F.col("vec_id").alias("rid"), "root", F.coalesce("n_links", F.lit(0)).alias("n_links")), "known")
    own = written(rows.select("vec_id", "rid").join(known, "rid", "left").select("vec_id", "root", "n_links"), "rows")
    # a vec_id that stands for several vectors ties their components
    several = own.where("root is not null").groupBy("vec_id").agg(F.min("root").alias("a"), F.collect_set("root").alias("roots")).where("size(roots) > 1")
    tied = written(components(written(several.select("a", F.explode("roots").alias("b")), "ties")), "tied").select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    own = own.join(sized_broadcast(tied), own["root"] == tied["_n"], "left").select("vec_id", F.coalesce("_r", "root").alias("root"), "n_links")
    smallest = own.where("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("vec_id").alias("smallest"), F.count("*").alias("n")).where("n > 1")
    out = own.join(sized_broadcast(written(smallest.select("of", "smallest"), "smallest")), F.col("root") == F.col("of"), "left")
    component = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
