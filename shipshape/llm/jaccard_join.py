"""Jaccard join of word-shingle sets (operator 9): regions around pivots, joined recursively and exactly.

Jaccard distance is a metric. Invented or natural texts are almost all at distance 1 from one
another, so hyperplanes between a few global pivots separate nothing: a window of twice the join
radius around each of them would copy every document into every region. The pivots of the first
level are therefore as many as the data ask for. Each document lists the few shingles of which any
partner within the radius must share one (its first ``n - ceil(t n) + 1`` in a global order with
frequent shingles last); the smallest document of each such shingle is a pivot, and a document is
copied into the region of every pivot that it meets. Two documents within the radius meet in at
least one region.

Most documents can be settled before that. Over a fixed slice of the shingle universe (1.6 times the
radius wide), shingles that occur in one distinct set only are counted per set; in an order with
those first, a set that has enough of them has no shingle to share and links with nothing. Only the
others list their shingles, once for each ring of set sizes (ratio 1.3) in which a partner may be.

Regions that are too large for a task are split again by Voronoi cells: pivots drawn from the
region, exact distances to them, each document in the cell of its nearest pivot and, as a boundary
copy, in every cell that the triangle inequality leaves open (distance to that pivot at most the
nearest distance plus twice the radius). A region that this doesn't shrink is cut into blocks, and
each pair of blocks becomes a region. Small regions are joined exactly: first on the slice of each
set, which bounds from above what two sets share, then on the whole sets of those documents that
the bound leaves together. Linked documents become components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from shipshape.llm.common import batches, components, mix, partitions, shingle_sets, sums, tidy, written, written_by

#: A region of more documents or shingles than this is split before it is joined.
REGION_DOCS = 1500
REGION_SHINGLES = 1_000_000
#: A shingle in this share of a chunk's documents (and of all documents) is frequent: it goes last.
FREQUENT = 0.001
#: Shingles counted at once when frequent ones are looked for.
CHUNK = 2_000_000
#: Voronoi levels before a region is cut into blocks; pivots of a region; member ids sent to every task.
DEPTH, PIVOTS, SENT_IDS = 3, 32, 2_000_000
#: Shingles of pivots that pass through the driver at one level; regions beyond that are cut into blocks.
PIVOT_SHINGLES = 20_000_000
#: Width of the slice in which lone shingles are counted, in radii; ratio of the size rings.
SLICE, RING = 1.6, 1.3


def _sketches(k: int):
    def run(it):
        held, docs = [], 0

        def frequent():
            vals, n = np.unique(np.concatenate(held), return_counts=True)
            hot = n >= max(4, FREQUENT * docs)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(hot.sum(), bool)), pa.nulls(int(hot.sum()), pa.int64()), pa.array(n[hot].astype("i8")),
                                               pa.array(vals[hot].view("i8")), pa.array(np.zeros(hot.sum(), "i8"))], names=["hot", "id", "n", "d1", "d2"])

        for b in it:
            vals, off = shingle_sets(b.column("text"), k)
            n = np.diff(off)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), bool)), b.column("id"), pa.array(n),
                                              pa.array(mix(sums(mix(vals), off)).view("i8")),
                                              pa.array(sums(mix(vals * np.uint64(0xD6E8FEB86659FD93)), off).view("i8"))],
                                             names=["hot", "id", "n", "d1", "d2"])
            held.append(vals)
            docs += len(n)
            if sum(map(len, held)) > CHUNK:
                yield frequent()
                held, docs = [], 0
        if docs:
            yield frequent()
    return tidy(run)


def _slices(k: int, num: int, den: int):
    """(shingle, set digest) of the universe's slice; a shingle of several sets of a batch comes once, with digest 0."""
    top = _top(SLICE, num, den)

    def run(it):
        for b in it:
            vals, off = shingle_sets(b.column("text"), k)
            digest = mix(sums(mix(vals), off)) | np.uint64(1)
            keep = vals < top
            own = np.repeat(digest, np.diff(off))[keep]
            vals, first, inv = np.unique(vals[keep], return_index=True, return_inverse=True)
            one = own[first]
            one[inv[own != one[inv]]] = 0
            yield pa.RecordBatch.from_arrays([pa.array(vals.view("i8")), pa.array(one.view("i8"))], names=["shingle", "d"])
    return tidy(run)


def _needed(n, num: int, den: int):
    """Shingles of a set of ``n`` of which any partner within the radius shares one."""
    return n - (num * n + den - 1) // den + 1


def _prefixes(k: int, num: int, den: int, frequent):
    def run(it):
        last = frequent.value
        for b in it:
            vals, off = shingle_sets(b.column("text"), k)
            n = np.diff(off)
            take = np.where(n > 0, _needed(n, num, den), 0)
            hot = np.zeros(len(vals), bool)
            if len(last):
                at = np.searchsorted(last, vals)
                hot = last[np.minimum(at, len(last) - 1)] == vals
            # rank of each shingle in its document: frequent ones after the others, each by hash
            cold = np.concatenate([[0], np.cumsum(~hot)])
            row = np.repeat(np.arange(len(n)), n)
            start = off[:-1][row]
            rank_cold = cold[:-1] - cold[start]
            rank = np.where(hot, np.arange(len(vals)) - start - rank_cold + (cold[off[1:]] - cold[off[:-1]])[row], rank_cold)
            keep = rank < take[row]
            vals, row = vals[keep], row[keep]
            ids = np.asarray(b.column("id"))
            ring = lambda m: np.floor(np.log(np.maximum(m, 1)) / np.log(RING)).astype("i8")
            low, high = ring(n), ring(den * n // num)
            for more in range(int((high - low).max(initial=0)) + 1):
                in_ring = (low + more <= high)[row]
                key = mix(vals[in_ring] + (low + more + 1).astype(np.uint64)[row[in_ring]] * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), pa.array(ids[row[in_ring]])], names=["shingle", "id"])
    return tidy(run)


def _only(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``base`` with one of ``ids``: by a set sent to every task if it is small (checked), else by a join."""
    if ids.count() > SENT_IDS:
        return base.join(ids, "id", "left_semi")
    wanted = base.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in ids.toLocalIterator()], "i8")))

    def run(it):
        w = wanted.value
        for b in it:
            own = np.asarray(b.column("id").fill_null(-1 << 62))
            hit = w[np.minimum(np.searchsorted(w, own), len(w) - 1)] == own if len(w) else np.zeros(len(own), bool)
            if hit.any():
                yield b.filter(pa.array(hit))
    return base.mapInArrow(tidy(run), base.schema)


def _top(radii: float, num: int, den: int) -> np.uint64:
    """Upper end of a slice of the shingle universe, ``radii`` times the radius wide."""
    return np.uint64(min(1.0, radii * (1 - num / den)) * (2**64 - 2048))


def _sets(k: int):
    """(id, n, shingles): the set of each document, in unsigned order."""
    def run(it):
        for b in it:
            vals, off = shingle_sets(b.column("text"), k)
            lists = pa.LargeListArray.from_arrays(pa.array(off), pa.array(vals.view("i8"))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(off)), lists], names=["id", "n", "shingles"])
    return tidy(run)


def _in_slice(num: int, den: int):
    """Of a column ``shingles`` what lies in the slice; the unsigned hashes are held in signed longs."""
    top = int(_top(SLICE, num, den))
    if top < 1 << 63:
        return F.filter("shingles", lambda x: (x >= 0) & (x < F.lit(top)))
    return F.filter("shingles", lambda x: (x >= 0) | (x < F.lit(top - (1 << 64))))


def _least_labels(linked: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    vals, inv, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    number = np.cumsum(df > 1) - 1
    keep = df[inv] > 1
    row, col = row[keep], number[inv[keep]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    step = 1024
    for c in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, b = np.searchsorted(col, [c, c + step])
        part = np.zeros((len(sets), step), np.float32)
        part[row[a:b], col[a:b] - c] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    np.fill_diagonal(common, [len(s) for s in sets])
    return common


def join_region(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Exact links of one region as (id, smallest linked-up id of the region)."""
    n = np.array([len(s) for s in sets])
    if len(ids) == 2:  # the usual region
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(max(ids)), int(min(ids)))] if den * both >= num * (n.sum() - both) else []
    order = np.argsort(ids, kind="stable")
    ids, sets, n = ids[order], [sets[i] for i in order], n[order]
    common = _common(sets)
    linked = den * common >= num * (n[:, None] + n[None, :] - common)
    label = _least_labels(linked)
    return [(int(ids[i]), int(ids[label[i]])) for i in np.flatnonzero(label != np.arange(len(ids)))]


def possible_groups(key: str, ids: np.ndarray, n: np.ndarray, parts: list[np.ndarray], num: int, den: int) -> list[tuple[str, int]]:
    """Smaller regions (region, id) that hold every link of a region, told from the slice alone.

    Two sets share at most what their slices share and all that the smaller rest holds; two documents
    that could then be linked, or are joined by a chain of such, stay together. Others leave.
    """
    rest = n - np.array([len(s) for s in parts])
    if len(ids) == 2:
        most = len(np.intersect1d(parts[0], parts[1], assume_unique=True)) + rest.min()
        return [(key, int(i)) for i in ids] if (num + den) * most >= num * n.sum() else []
    most = _common(parts) + np.minimum(rest[:, None], rest[None, :])
    label = _least_labels((num + den) * most >= num * (n[:, None] + n[None, :]))
    together = np.bincount(label, minlength=len(ids))[label] > 1
    return [(f"{key}/{ids[label[i]]}", int(ids[i])) for i in np.flatnonzero(together)]


def _each_region(column: str, close, types: dict):
    """Partitions sorted by region, one region held at a time: the rows of ``close(region, ids, n, sets)``."""
    def run(it):
        now, ids, n, sets = None, [], [], []

        def closed():
            return close(now, np.array(ids), np.array(n), sets) if len(ids) > 1 else []

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))

        for b in it:
            keys, members, size = b.column("region").to_pylist(), np.asarray(b.column("id")), np.asarray(b.column("n"))
            lists, out = b.column(column), []
            off, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
            for i, key in enumerate(keys):
                if key != now:
                    out += closed()
                    now, ids, n, sets = key, [], [], []
                ids.append(members[i])
                n.append(size[i])
                sets.append(flat[off[i]:off[i + 1]].copy())
            if out:
                yield batch(out)
        if out := closed():
            yield batch(out)
    return tidy(run)


def _cells(pivots, num: int, den: int):
    """Voronoi cells with boundary copies: (region, id) -> one row per cell that may hold a partner."""
    def run(it):
        radius2 = 2 * (1 - num / den) + 1e-9
        for b in it:
            keys, ids, out = b.column("region").to_pylist(), b.column("id").to_pylist(), []
            lists = b.column("shingles")
            off, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
            for i, key in enumerate(keys):
                own = flat[off[i]:off[i + 1]]
                vals, which, sizes = pivots.value[key]
                at = np.minimum(np.searchsorted(own, vals), max(len(own) - 1, 0))
                both = np.bincount(which[own[at] == vals] if len(own) else which[:0], minlength=len(sizes))
                d = 1 - both / (len(own) + sizes - both)
                out += [(key, int(j), ids[i]) for j in np.flatnonzero(d <= d.min() + radius2)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64())],
                                             names=["region", "cell", "id"])
    return tidy(run)


def _blocks(members: DataFrame) -> DataFrame:
    """Large regions (region, id, parts, docs) as pairs of blocks: each document in as many pairs as there are blocks."""
    half = F.least(F.col("parts") * 2, F.col("docs"))
    cut = members.select("region", "id", half.alias("half"), F.pmod(F.xxhash64("id"), half).alias("block"))
    cut = cut.select("region", "id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("half").cast("long") - 1)).alias("other"))
    return cut.select(F.concat_ws(":", "region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "id")


def _split(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(region, id) in which every region is small enough for one task."""
    spark, done = members.sparkSession, []
    for depth in range(DEPTH + 1):
        members = written(members.join(sets.select("id", "n"), "id"))
        size = members.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
        size = size.withColumn("parts", F.ceil(F.greatest(F.col("docs") / REGION_DOCS, F.col("total") / REGION_SHINGLES)))
        large = written(size.where("parts > 1").select("region", "parts", "docs"))
        if large.isEmpty():
            done.append(members.select("region", "id"))
            break
        done.append(members.join(large, "region", "left_anti").select("region", "id"))
        members = members.join(large, "region")
        if depth == DEPTH:
            done.append(_blocks(members))
            break
        # a slot for every document, so every region has a pivot; of few documents (or sets too large for the driver) no cells are made
        slots = F.least(F.lit(PIVOTS), F.col("parts") * 4).cast("int")
        drawn = written(members.withColumn("draw", F.xxhash64("id", F.lit(depth)))
                 .groupBy("region", "parts", F.pmod("draw", slots).alias("slot")).agg(F.min_by("id", "draw").alias("id"))
                 .join(sets.select("id", "n"), "id").select("region", "id", "n"))
        size = drawn.groupBy("region").agg(F.sum("n").alias("sent")).join(large.where(F.col("docs") > slots), "region")
        sent = written(size.withColumn("sum", F.sum("sent").over(Window.orderBy("sent", "region"))).where(F.col("sum") <= PIVOT_SHINGLES).select("region"))  # a row per large region
        done.append(_blocks(members.join(sent, "region", "left_anti")))
        members = members.join(sent, "region", "left_semi")
        drawn = drawn.join(sent, "region", "left_semi").join(sets.select("id", "shingles"), "id").select("region", "shingles")
        held: dict[str, list] = {}
        for r in drawn.toLocalIterator():  # at most PIVOT_SHINGLES
            held.setdefault(r["region"], []).append(np.array(r["shingles"], "i8").view(np.uint64))
        pivots = {key: (np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x]), np.array([len(y) for y in x])) for key, x in held.items()}
        shared = spark.sparkContext.broadcast(pivots)
        cells = written(members.select("region", "id").join(sets, "id").select("region", "id", "shingles")
                        .mapInArrow(_cells(shared, num, den), "region string, cell int, id long"))
        # cells that copy most documents separate nothing: such a region goes to pairs of blocks
        copied = cells.groupBy("region").agg(F.count("*").alias("copies")).join(large, "region").where("copies > 2 * docs").select("region")
        done.append(_blocks(members.join(copied, "region", "left_semi")))
        members = cells.join(copied, "region", "left_anti").select(F.concat_ws(".", "region", "cell").alias("region"), "id")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of all regions of ``members`` (region, id): whole sets only of what the slices leave together."""
    def by_region(regions, column):
        return (regions.join(sets.select("id", "n", column), "id").repartition(partitions(sets.sparkSession), "region")
                .sortWithinPartitions("region", "id"))

    regions = by_region(_split(members, sets, num, den), "part").mapInArrow(
        _each_region("part", lambda key, ids, n, parts: possible_groups(key, ids, n, parts, num, den), {"region": pa.string(), "id": pa.int64()}), "region string, id long")
    return written(by_region(written(regions), "shingles").mapInArrow(
        _each_region("shingles", lambda key, ids, n, sets: join_region(ids, sets, num, den), {"a": pa.int64(), "b": pa.int64()}), "a long, b long"))


def _slice_rows(num: int, den: int):
    top = _top(2 * SLICE, num, den)

    def run(it):
        for b in it:
            lists = b.column("shingles")
            off, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
            flat, n = flat[off[0]:off[-1]], np.diff(off).astype("i8")
            keep = flat < top
            ids, roots = (np.repeat(np.asarray(b.column(c)), n)[keep] for c in ("id", "root"))
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep].view("i8")), pa.array(ids), pa.array(roots)], names=["shingle", "id", "root"])
    return tidy(run)


def _unsettled(sets: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """Ids that may link outside their component (``label``: id, root).

    In an order with those shingles of a slice first that occur in one component only, a set that
    has enough of them meets a partner within its component only.
    """
    spark = sets.sparkSession
    rooted = sets.join(label, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "shingles")
    rows = rooted.mapInArrow(_slice_rows(num, den), "shingle long, id long, root long").repartition(partitions(spark), "shingle")
    shared = rows.groupBy("shingle").agg(F.min("root").alias("r"), F.max("root").alias("r_max")).where("r <> r_max").select("shingle")
    lone = rows.join(shared.hint("shuffle_hash"), "shingle", "left_anti").groupBy("id").agg(F.count("*").alias("lone"))
    needed = F.expr(f"n - (({num} * n + {den} - 1) div {den}) + 1")
    return sets.select("id", "n").join(lone, "id", "left").where(F.coalesce("lone", F.lit(0)) < needed).select("id")


def _members(pairs: DataFrame) -> DataFrame:
    """(region, id) of pairs (p, x): the region of every pivot p holds p and its x."""
    return pairs.select(F.col("p").cast("string").alias("region"), F.col("x").alias("id")).union(pairs.select(F.col("p").cast("string"), "p").distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       num: int = 80, den: int = 100) -> DataFrame:
    """Link documents of which ``den * |A and B| >= num * |A or B|`` over distinct ``words``-word shingles.

    Returns one row per input row: id, n_shingles, component_id (the smallest id reachable by
    links). Texts are lower-cased in A-Z and cut at white space; fewer words than a shingle make one
    shingle of the whole sequence. Empty or null texts have no shingle and link with nothing, not
    even one another. Rows with a null id get a null component and take no part. Rows that repeat an
    id are one document: the greatest of their texts links, all get its component, each its own
    n_shingles. An empty table gives an empty result. Shingles are held as 64-bit hashes.
    """
    spark = docs.sparkSession
    batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("hot", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("id", "n", "d1", "d2"))])
    sketch = written(base.mapInArrow(_sketches(words), schema))
    rows = own = sketch.where("not hot").drop("hot")
    if not own.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        base = written(base.where("id is not null").groupBy("id").agg(F.max("text").alias("text")))
        sketch = written(base.mapInArrow(_sketches(words), schema))
        own = sketch.where("not hot").drop("hot")
    frequent = (sketch.where("hot").groupBy("d1").agg(F.sum("n").alias("n"))
                .join(own.agg(F.greatest(F.lit(20.0), F.count("*") * F.lit(FREQUENT)).alias("least")))
                .where("n >= least").select("d1"))
    # at most (mean shingles of a document) / FREQUENT entries, whatever the size of the corpus
    last = np.sort(np.array([r[0] for r in frequent.toLocalIterator()], "i8").view(np.uint64))
    shared = spark.sparkContext.broadcast(last)

    valid = own.where("id is not null and n > 0")
    first = valid.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    reps = written(valid.join(first, ["d1", "d2", "n"]).select("id", "rep", "d1", "n"))

    sliced = base.mapInArrow(_slices(words, num, den), "shingle long, d long").repartition(partitions(spark), "shingle")
    lone = sliced.groupBy("shingle").agg(F.min("d").alias("d"), F.max("d").alias("d_max")).where("d = d_max and d <> 0")
    lone = lone.groupBy("d").agg(F.count("*").alias("lone"))
    needed = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    open_ = written(reps.where("id = rep").join(lone, F.col("d1").bitwiseOR(F.lit(1)) == F.col("d"), "left")
                    .where(F.coalesce("lone", F.lit(0)) < needed).select("id"))

    prefix = _only(base, open_).mapInArrow(_prefixes(words, num, den, shared), "shingle long, id long").repartition(partitions(spark), "shingle")
    met = prefix.groupBy("shingle").agg(F.min("id").alias("p"), F.max("id").alias("other")).where("p < other").select("shingle", "p")
    pairs = written(prefix.join(met.hint("shuffle_hash"), "shingle").where("p < id").groupBy("p", F.col("id").alias("x")).agg(F.count("*").alias("met")))
    # the sets are shuffled by id once; whatever is joined to them afterwards comes to their buckets
    sets = _only(base, written(pairs.select("x").union(pairs.select("p")).distinct().toDF("id"))).mapInArrow(_sets(words), "id long, n long, shingles array<long>")
    sets = written_by(sets, "id", part=_in_slice(num, den))

    # first each document with its nearest pivot only, then the regions of what may still link elsewhere
    nearest = pairs.groupBy("x").agg(F.max_by("p", F.struct("met", -F.col("p"))).alias("p"))
    edges = _links(_members(nearest), sets, num, den)
    label = components(edges, "a", "b")
    left = written(_unsettled(sets, label, num, den))
    pairs = pairs.join(left.toDF("x"), "x")
    rest = pairs.select(F.col("p").cast("string").alias("region"), F.col("x").alias("id")).union(
        pairs.select("p").distinct().join(left.toDF("p"), "p").select(F.col("p").cast("string"), "p"))
    # a region within one component has nothing to add
    several = (rest.join(label, "id", "left").groupBy("region").agg(F.min(F.coalesce("root", "id")).alias("low"), F.max(F.coalesce("root", "id")).alias("high"))
               .where("low <> high").select("region"))
    edges = edges.union(_links(rest.join(several, "region", "left_semi"), sets, num, den))
    roots = components(edges, "a", "b")
    comp = reps.select("id", "rep").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("component_id"))
    return (rows.join(comp, "id", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "id").alias("component_id")))

