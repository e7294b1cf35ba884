"""N-gram Jaccard self-join of whole texts by T-occurrence search (DivideSkip), exact but for collisions of
48-bit shingle hashes.

A document is the set of its distinct word shingles. Documents x, y link when their sets' Jaccard similarity
reaches the threshold, so y must occur in at least T = threshold * |x| of the inverted lists of x's shingles.

1. Blocks. Tasks cut their documents into blocks of about a million shingles and write each block's postings,
   sorted and delta-coded, one row per (block, bucket of keys). The blocks are a written table, so a task
   that runs again cannot number them differently.
2. List lengths. A bucket gets each block's distinct keys with counts (a hot key once per block, not once per document),
   adds them up and answers with the lengths of the lists, one byte a key (255: or more).
3. Back in its block every document keeps only shingles whose list holds another document; one that keeps
   fewer than T of them cannot link and is done. Equal sets are then folded to one class, and steps
   1 to 3 run again over the classes, so that copies no longer count as company.
4. Stars. With a class's lists ordered by (length, key), two classes that link share one of their first
   s - T + 1 lists (s shingles kept). Each list joins its classes to its smallest one; these pairs are verified and give
   first components. Pairs inside a component are never built: a group of n near copies costs n pairs a list.
5. DivideSkip. Lists that still hold several components tie classes into regions, and a region goes to one task
   (large ones as pairs of tiles of bounded size). There every class outside the largest component sets aside its
   L longest lists (L = T / (MU log2 M + 1), M the longest), merges the others counting occurrences (numpy merges
   the sorted runs at once in place of a heap, with the same counts), drops what occurs less than T - L times,
   and finds the rest in the long lists by binary search, dropping a candidate as soon as it cannot reach
   the overlap that both sizes ask for. Only links that join two components leave the task.

Nulls and edges: a null or wordless text has no shingles and links with nothing; fewer words than a
shingle count as one shingle; a null doc_id links with nothing and has a null component; repeated doc_ids are
one node; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import dropped, release, sized_broadcast, small_batches, text_chunks, written
from wayfold.llm.components import components
from wayfold.llm.words import mix, word_bounds, word_hashes

#: Bits of a list key, and of its part behind the bucket's bits by which lists are measured (longer keys may share a
#: length, which only lets more pass); shingles of a block, of a bucket and of a tile.
KEY, MEASURED, BLOCK, BUCKET, TILE = 48, 28, 600_000, 1_000_000, 1_000_000
#: The weight of DivideSkip's rule for the number of long lists.
MU = 0.01
_rng = np.random.default_rng(5)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _total(x: np.ndarray, more: int) -> np.ndarray:
    return np.array([(int(x.sum(dtype=np.uint64)) + more) % 2**64], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a buffer."""
    starts, ends, first = word_bounds(data, offsets)
    w = word_hashes(data, starts, ends, lower=True)
    n = np.diff(first)
    full = np.zeros(max(0, len(w) - size + 1), np.uint64)
    for k in range(size):
        full += w[k : k + len(full)] * _PLACE[k]
    full = mix(full)
    out = []
    for a, m in zip(first[:-1].tolist(), n.tolist()):
        if m >= size:
            out.append(np.unique(full[a : a + m - size + 1]))
        elif m:
            out.append(mix(_total(w[a : a + m] * _PLACE[:m], m * int(_PLACE[63]))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_class(s: np.ndarray) -> np.uint64:
    """64-bit identity of a whole set."""
    return mix(_total(mix(s ^ np.uint64(0x9E3779B97F4A7C15)), len(s) * int(_PLACE[62])))[0]


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes: the count, the number of planes, the planes."""
    x = np.ascontiguousarray(x, "<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = x.view(np.uint8).reshape(-1, 8).T[:width]
    return len(x).to_bytes(4, "little") + bytes([width]) + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if width else b"")


def unpack(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    out = np.zeros((n, 8), np.uint8)
    if width:
        raw = pa.decompress(memoryview(blob)[5:], decompressed_size=n * width, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x[:1] * 0))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def _tail(bits: int) -> np.uint64:
    return np.uint64(max(0, KEY - bits - MEASURED))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array start, and its length."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)) if len(x) else np.zeros(1, np.int64)


#: What a reader of batches gives: ids, whether they count, set sizes, classes, sorted 48-bit keys.
Sets = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]
BLOCKS = "block long, bucket long, keys binary, tails binary, counts binary, who binary, ids array<long>, known array<boolean>, n array<long>, class array<long>"


def from_texts(size: int) -> Callable[[pa.RecordBatch], Iterator[Sets]]:
    """Sets of (doc_id, text) rows. Rows with a null doc_id post nothing."""

    def read(batch: pa.RecordBatch) -> Iterator[Sets]:
        for lo, hi, data, offsets in text_chunks(batch.column(1), 1 << 20):
            sets = shingle_sets(data, offsets, size)
            ids = batch.column(0).slice(lo, hi - lo)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            n = np.array([len(s) for s in sets], np.int64)
            cls = np.array([set_class(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield ids.fill_null(0).to_numpy(), known, n, cls, [s >> np.uint64(64 - KEY) if k else s[:0] for s, k in zip(sets, known.tolist())]

    return read


def from_classes(batch: pa.RecordBatch) -> Iterator[Sets]:
    """Sets of (class, n, keys) rows."""
    cls, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    yield cls, np.ones(len(cls), bool), n, cls, [unpack_sorted(k) for k in batch.column(2).to_pylist()]


def blocks(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Sets]], bits: int) -> DataFrame:
    """BLOCKS: the postings of a block by bucket, and one row with bucket -1 that lists its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[Sets] = []
        turn, tail = 0, _tail(bits)

        def flush() -> pa.RecordBatch:
            ids, known, n, cls = (np.concatenate([h[i] for h in held]) for i in range(4))
            sets = [s for h in held for s in h[4]]
            who = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            key = np.concatenate(sets)
            order = np.argsort(key, kind="stable")
            key, who = key[order], who[order]
            cuts = _runs(key >> np.uint64(KEY - bits))
            bucket, keys, tails, counts, whose = [-1], [None], [None], [None], [None]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = key[a:b]
                at = _runs(own)
                bucket.append(int(own[0]) >> (KEY - bits))
                own = own[at[:-1]]
                keys.append(pack_sorted(own >> tail))
                tails.append(pack(own & ((np.uint64(1) << tail) - np.uint64(1))))
                counts.append(pack(np.diff(at)))
                whose.append(pack(who[a:b]))
            lists = [pa.array([x.tolist()] + [None] * (len(bucket) - 1), pa.list_(t)) for x, t in ((ids, pa.int64()), (known, pa.bool_()), (n, pa.int64()), (cls, pa.int64()))]
            block = np.full(len(bucket), (TaskContext.get().partitionId() << 32) + turn, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(block), pa.array(bucket, pa.int64()), pa.array(keys, pa.binary()), pa.array(tails, pa.binary()), pa.array(counts, pa.binary()), pa.array(whose, pa.binary()), *lists], names=["block", "bucket", "keys", "tails", "counts", "who", "ids", "known", "n", "class"])

        size = rows_held = 0
        for batch in batches:
            for sets in read(batch):
                held.append(sets)
                size += sum(map(len, sets[4]))
                rows_held += len(sets[0])
                if size >= BLOCK or rows_held >= 50_000:
                    yield flush()
                    held, size, rows_held, turn = [], 0, 0, turn + 1
        if rows_held:
            yield flush()

    return rows.mapInArrow(run, BLOCKS)


def list_lengths(posted: DataFrame) -> DataFrame:
    """block, bucket, codes: for the distinct keys of a block in a bucket the length of their lists over all blocks, up to
    255; only for rows with some list of two or more."""

    def run(table: pa.Table) -> pa.Table:
        runs, counts = [unpack_sorted(k) for k in table["keys"].to_pylist()], [unpack(c) for c in table["counts"].to_pylist()]
        key = np.concatenate(runs)
        order = np.argsort(key, kind="stable")
        at = _runs(key[order])
        length = np.add.reduceat(np.concatenate(counts)[order], at[:-1])
        codes = np.empty(len(key), np.uint8)
        codes[order] = np.repeat(np.minimum(length, 255), np.diff(at)).astype(np.uint8)
        ends = np.cumsum([len(r) for r in runs])
        codes = [codes[e - len(r) : e] for r, e in zip(runs, ends.tolist())]
        some = [i for i, c in enumerate(codes) if (c > 1).any()]
        return pa.table({"block": table["block"].combine_chunks().take(pa.array(some, pa.int64())), "bucket": table["bucket"].combine_chunks().take(pa.array(some, pa.int64())), "codes": pa.array([pack(codes[i]) for i in some], pa.binary())})

    return posted.where("bucket >= 0").select("block", "bucket", "keys", "counts").groupBy("bucket").applyInArrow(run, "block long, bucket long, codes binary")


def in_company(posted: DataFrame, percent: int, bits: int) -> DataFrame:
    """id, class, n, kept, keys, codes of the sets of which at least the threshold's share of shingles is in lists
    with others, and those shingles alone."""
    names = "id long, class long, n long, kept int, keys binary, codes binary"
    schema = pa.schema([("id", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("kept", pa.int32()), ("keys", pa.binary()), ("codes", pa.binary())])

    def run(own: pa.Table, lengths: pa.Table) -> pa.Table:
        release()
        if not own.num_rows or not lengths.num_rows:
            return schema.empty_table()
        codes = dict(zip(lengths["bucket"].to_pylist(), lengths["codes"].to_pylist()))
        own = own.sort_by("bucket")
        ids, known, n, cls = (np.array(own[c][0].as_py()) for c in ("ids", "known", "n", "class"))
        key, code, who = [], [], []
        for bucket, k, t, c, w in zip(*(own[x].to_pylist() for x in ("bucket", "keys", "tails", "counts", "who"))):
            if bucket in codes:
                counts, of = unpack(c).astype(np.int64), unpack(codes[bucket])
                use = np.repeat(of > 1, counts)
                key.append(np.repeat((unpack_sorted(k) << _tail(bits)) | unpack(t), counts)[use])
                code.append(np.repeat(of, counts)[use].astype(np.uint8))
                who.append(unpack(w)[use].astype(np.int64))
        key, code, who = np.concatenate(key), np.concatenate(code), np.concatenate(who)
        kept = np.bincount(who, minlength=len(n))
        live = known & (n > 0) & (100 * kept >= percent * n)
        use = live[who]
        key, code, who = key[use], code[use], who[use]
        order = np.argsort(who, kind="stable")  # a document's keys stay in order
        key, code = key[order], code[order]
        at = np.flatnonzero(live)
        ends = np.cumsum(kept[at])
        spans = list(zip((ends - kept[at]).tolist(), ends.tolist()))
        return pa.table([ids[at], cls[at], n[at], kept[at].astype(np.int32), pa.array([pack_sorted(key[a:b]) for a, b in spans], pa.binary()), pa.array([pack(code[a:b]) for a, b in spans], pa.binary())], schema=schema)

    return posted.groupBy("block").cogroup(list_lengths(posted).groupBy("block")).applyInArrow(run, names)


def first_lists(classes: DataFrame, percent: int) -> DataFrame:
    """key, class, n, most: the first lists of each class in order of (length, key), and the largest set that a
    partner met in this list can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for cls, n, k, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                key, code = unpack_sorted(k), unpack(c)
                need = (percent * n + 99) // 100
                first = np.lexsort((key, code))[: len(key) - need + 1]
                most = (len(key) - np.arange(len(first))) * (100 + percent) // percent - n
                parts.append((key[first].view(np.int64), np.full(len(first), cls), np.full(len(first), n), most))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in range(4)], names=["key", "class", "n", "most"])

    return classes.select("class", "n", "keys", "codes").mapInArrow(run, "key long, class long, n long, most long")


def occurrences(x: np.ndarray, y: np.ndarray) -> int:
    """In how many of x's lists y occurs, by binary search of the shorter sorted set in the longer."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                both = occurrences(unpack_sorted(x), unpack_sorted(y))
                keep.append(100 * both >= percent * (n + m - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"of_{c}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "n_b", "of_a", "of_b")
    return joined.mapInArrow(run, "a long, b long")


def divide_skip(lists: list[np.ndarray], need: int, fits: Callable[[np.ndarray], np.ndarray], goal: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, dict[str, int]]:
    """T-occurrence search: the ids that occur in at least goal(ids) >= need of the sorted lists, of those that fit.
    Also gives the number of long lists, and of ids merged, left after the count, and probed in long lists."""
    lists = sorted(lists, key=len)
    longest = len(lists[-1]) if lists else 0
    aside = min(need - 1, len(lists), int(need / (MU * np.log2(max(longest, 2)) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    merged = np.sort(np.concatenate(short), kind="stable") if short else np.zeros(0, np.int64)  # a merge of sorted runs
    at = _runs(merged)
    ids, count = merged[at[:-1]], np.diff(at)
    ids, count = ids[count >= need - aside], count[count >= need - aside]
    use = fits(ids)
    ids, count = ids[use], count[use]
    said = {"long": aside, "merged": len(merged), "counted": len(ids), "probed": 0}
    goals = goal(ids)
    for left, one in zip(range(aside, 0, -1), long):
        use = count + left >= goals
        ids, count, goals = ids[use], count[use], goals[use]
        if not len(ids):
            break
        said["probed"] += len(ids)
        place = np.searchsorted(one, ids)
        count = count + (one[np.minimum(place, len(one) - 1)] == ids)
    return ids[count >= goals], said


def region_links(members: DataFrame, percent: int) -> DataFrame:
    """members (task, region, tile, class, comp, n, keys) -> links (a, b) that join two components, found by
    DivideSkip within each task's rows; rows of two tiles meet only across the tiles."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        cls, comp, n, region, tile = (table[c].to_numpy() for c in ("class", "comp", "n", "region", "tile"))
        sets = [unpack_sorted(k) for k in table["keys"].to_pylist()]
        kept = np.array([len(s) for s in sets], np.int64)
        most = kept * (100 + percent) // percent - n
        who = np.repeat(np.arange(len(sets)), kept)
        key = np.concatenate(sets)
        order = np.argsort(key, kind="stable")  # ids ascend within a list
        key, who = key[order], who[order]
        at = _runs(key)
        number = np.empty(len(key), np.int64)
        number[order] = np.repeat(np.arange(len(at) - 1), np.diff(at))
        starts = np.cumsum(kept) - kept
        apart = tile.max() != tile.min() and (region == region[0]).all()
        names, comp = np.unique(comp, return_inverse=True)
        size = np.bincount(comp)
        biggest = {}
        for r, c in {(int(r), int(c)) for r, c in zip(region, comp)}:
            if r not in biggest or size[c] > size[biggest[r]]:
                biggest[r] = c
        skip = np.array([biggest[r] for r in region.tolist()]) == comp
        left, right = [], []
        for x in np.flatnonzero(~skip).tolist():
            own = number[starts[x] : starts[x] + kept[x]]
            lists = [who[at[i] : at[i + 1]] for i in own.tolist() if at[i + 1] - at[i] > 1]
            need = int(percent * n[x] + 99) // 100

            def fits(ids: np.ndarray, x: int = x) -> np.ndarray:
                ok = (comp[ids] != comp[x]) & (region[ids] == region[x]) & (n[ids] <= most[x]) & (n[x] <= most[ids])
                return ok & (tile[ids] != tile[x]) if apart else ok

            goal = lambda ids, x=x: (percent * (n[ids] + n[x]) + 99 + percent) // (100 + percent)
            if len(lists) < need:
                continue
            found, _ = divide_skip(lists, need, fits, goal)
            for y in found.tolist():
                if comp[y] != comp[x]:
                    left.append(cls[x])
                    right.append(cls[y])
                    comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return members.groupBy("task").applyInArrow(run, "a long, b long")


def residual_links(lists: DataFrame, classes: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between the components of links, from the first lists that hold several of them."""
    comps = written(components(links), "components").select(F.col("node").alias("_c"), F.col("root").alias("comp"))
    labelled = lists.select("key", "class").join(comps, F.col("class") == F.col("_c"), "left").select("key", "class", F.coalesce("comp", "class").alias("comp"))
    several = labelled.groupBy("key").agg(F.min("class").alias("lead"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    ties = written(lists.select("key", "class").join(several.select("key", "lead"), "key").select(F.col("lead").alias("a"), F.col("class").alias("b")).distinct(), "ties")
    regions = written(components(ties), "regions").select(F.col("node").alias("class"), F.col("root").alias("region"))
    members = classes.join(regions, "class").join(comps, F.col("class") == F.col("_c"), "left")
    members = members.select("region", "class", F.coalesce("comp", "class").alias("comp"), "n", "kept", "keys")
    sizes = written(members.groupBy("region").agg(F.sum("kept").alias("total")), "region-sizes")
    tasks = max(1, int((sizes.agg(F.sum("total")).first()[0] or 0) / TILE))
    sizes = sizes.select("region", F.ceil(F.col("total") / TILE).cast("int").alias("tiles"))
    dealt = members.join(sizes, "region").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = F.xxhash64("region", F.least("tile", "other"), F.greatest("tile", "other"))
    dealt = dealt.withColumn("task", F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("region"), F.lit(tasks))).otherwise(pair))
    return region_links(dealt.select("task", "region", "tile", "class", "comp", "n", "keys"), percent)


def _bits(shingles: float) -> int:
    return max(5, int(shingles / BUCKET).bit_length())


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, one row per row of docs; then text_class, the same for
    equal sets, and group_id, the same for the classes of a component (null without shingles)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _bits(chars / 6)
    posted = written(blocks(docs, from_texts(size), bits), "blocks")
    each = F.explode(F.arrays_zip("ids", "known", "n", "class")).alias("x")
    sigs = posted.where("bucket = -1").select(each).select(F.when(F.col("x.known"), F.col("x.ids")).alias("doc_id"), F.col("x.n").alias("n_shingles"), F.col("x.class").alias("class"))
    sigs = written(sigs, "signatures")
    rows = written(in_company(posted, percent, bits), "in-company")
    dropped(posted)
    folded = written(rows.groupBy("class").agg(F.first("n").alias("n"), F.sum("kept").alias("kept"), F.first("keys").alias("keys")), "classes")
    dropped(rows)
    bits = _bits(folded.agg(F.sum("kept")).first()[0] or 0)
    again = written(blocks(folded.select("class", "n", "keys"), from_classes, bits), "class-blocks")
    classes = written(in_company(again, percent, bits), "classes-in-company")
    dropped(again, folded)
    lists = written(first_lists(classes, percent), "lists")
    leads = lists.groupBy("key").agg(F.min(F.struct("class", "n", "most")).alias("lead"), F.count("*").alias("length")).where("length > 1").select("key", "lead")
    fit = (F.col("class") > F.col("lead.class")) & (F.col("n") <= F.col("lead.most")) & (F.col("lead.n") <= F.col("most"))
    stars = written(lists.join(leads, "key").where(fit).select(F.col("lead.class").alias("a"), F.col("class").alias("b")).distinct(), "stars")
    links = written(verified(stars, classes, percent), "links")
    more = written(residual_links(lists, classes, links, percent), "more-links")
    comps = written(components(links.unionByName(more)), "components")
    rows = sigs.join(sized_broadcast(comps), sigs["class"] == comps["node"], "left").withColumn("comp", F.coalesce("root", "class"))
    rows = rows.select("doc_id", "n_shingles", "class", F.when(F.col("n_shingles") > 0, F.col("comp")).alias("comp"))
    smallest = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n"))
    smallest = written(smallest.where("n > 1").select(F.col("comp").alias("of"), "smallest"), "smallest")
    joined = rows.join(sized_broadcast(smallest), rows["comp"] == smallest["of"], "left")
    joined = joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id")).alias("group_smallest"), F.col("class").alias("text_class"), F.col("comp").alias("group_id"))
    return tied(joined).select("doc_id", "n_shingles", "component_id", "text_class", "group_id", "group_smallest")


def tied(rows: DataFrame) -> DataFrame:
    """rows with component_id: group_smallest, but groups of texts that share a doc_id are one component, as a doc_id is one node."""
    shared = rows.where("doc_id is not null and group_id is not null").groupBy("doc_id").agg(F.min("group_id").alias("a"), F.max("group_id").alias("last"))
    shared = written(shared.where("a <> last").select("doc_id", "a"), "shared-ids")
    if shared.isEmpty():
        return rows.withColumn("component_id", F.col("group_smallest"))
    ties = rows.where("group_id is not null").join(shared, "doc_id").select("a", F.col("group_id").alias("b")).distinct()
    root = written(components(written(ties, "ties")), "tied").select("node", "root")
    rows = written(rows.join(sized_broadcast(root), rows["group_id"] == root["node"], "left").withColumn("root", F.coalesce("root", "group_id")).drop("node"), "tied-rows")
    least = written(rows.where("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("least")), "least")
    found = rows.join(least, rows["root"] == least["of"], "left")
    return found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "group_smallest")))


def text_classes(docs: DataFrame, name: str, size: int = 5) -> DataFrame:
    """docs with the class of each row's text as column name, which docs must not have."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(at), 1 << 20):
                cls = np.array([set_class(s) if len(s) else 0 for s in shingle_sets(data, offsets, size)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(cls)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
