"""Benchmark decontamination (operator 4): SimHash of item-sized windows, multi-index Hamming blocks, exact check.

DataFrame functions only. Word shingles of a document are hashed once. A window of an item's size is
laid at every start, also over the ends of a text, at which it holds so many shingles of items of
that size, at whatever offsets, that its similarity with one of them can reach the bound; every other
window stays below it and is skipped without loss. Each window gets a 64-bit SimHash of its shingles,
each weighted by its count. Fingerprints are cut into 8 blocks of 8 bits; two fingerprints within
``8 * (PROBE + 1) - 1 = 23`` bits agree in at least one block up to PROBE bits, so probing every
block value within PROBE bits returns all of them. Candidates of the same size are verified by the
exact weighted similarity: sum of the smaller counts over sum of the larger counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shipshape.llm.common import written

PUNCTUATION = ".,;:!?\"'()[]{}<>|*#%&$_`~-"
BLOCKS, BITS, PROBE = 8, 8, 2
RADIUS = BLOCKS * (PROBE + 1) - 1
#: Item shingles that are sent to every executor; a larger benchmark is joined by shuffle.
SENT_SHINGLES = 1_000_000
#: Windows whose places are sent to every executor; more are joined by shuffle.
SENT_PLACES = 200_000


def normal_words(text: Column) -> Column:
    """Lower-cased words, punctuation taken for white space (null: none)."""
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " " * len(PUNCTUATION))
    return F.array_remove(F.split(spaced, r"[\x20\x09-\x0D]+"), "")


def word_shingles(words: Column, k: int, sized: bool = False) -> Column:
    """Hashes of the ``k``-word shingles in order; none if there are fewer words. ``sized``: (h, size) with the number of words.

    The words are bound as the variable of an outer ``transform``, else the optimizer inlines their
    split into the inner one and evaluates it for every shingle.
    """
    def of(w: Column) -> Column:
        def one(i: Column) -> Column:
            h = F.xxhash64(*(F.get(w, i + j) for j in range(k)))
            return F.struct(h.alias("h"), F.size(w).alias("size")) if sized else h
        return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), one)).otherwise(
            F.array().cast("array<struct<h:bigint,size:int>>" if sized else "array<bigint>"))
    return F.get(F.transform(F.array(words), of), 0)


def _adds(k: int):
    return lambda acc, x: acc + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(0x0000000100000001))


def simhash(shingles: Column) -> Column:
    """64-bit SimHash: bit b is set if more than half of the shingles have it. Two 32-bit counters share a long."""
    bits = F.lit(0).cast("long")
    for k in range(32):
        sums = F.aggregate(shingles, F.lit(0).cast("long"), _adds(k))
        for lane, b in ((0, k), (32, k + 32)):
            count = F.shiftrightunsigned(sums, lane).bitwiseAND(F.lit(0xFFFFFFFF))
            bits = bits.bitwiseOR(F.when(count * 2 > F.size(shingles), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def blocks(fingerprint: Column) -> Column:
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, b * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).alias("value")) for b in range(BLOCKS)))


def numbered(shingles: Column) -> Column:
    """Shingles with repeats told apart by their number, so that sets of them intersect as bags do."""
    def of(s: Column) -> Column:
        return F.transform(s, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(s, x)))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.transform(shingles, lambda x: F.xxhash64(x, F.lit(0).cast("long")))).otherwise(
        F.get(F.transform(F.array(F.array_sort(shingles)), of), 0))


def starts(met: DataFrame, similarity: float) -> DataFrame:
    """(id, t, size, at, n_words, k): every window start whose shared shingles may reach ``similarity``.

    ``met`` has the distinct places i of shared shingles, by row (id, t; ``size`` words) and item size.
    A window at ``at`` holds those of ``at`` to ``at + n_words - k``: their number steps up where the
    window begins to hold one and down behind it. With m shingles of the item and m2 of the window
    (fewer at the ends of a text), c shared ones give a similarity of at most c / (m + m2 - c).
    """
    one = ["id", "t", "size", "n_words", "k"]
    m = F.col("n_words") - F.col("k") + 1
    steps = met.select(*one, F.explode(F.array(F.struct((F.col("i") - m + 1).alias("at"), F.lit(1).alias("step")), F.struct((F.col("i") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = steps.groupBy(*one, "e.at").agg(F.sum("e.step").alias("step"))
    by = Window.partitionBy(*one).orderBy("at")
    runs = steps.select(*one, "at", F.sum("step").over(by).alias("shared"), (F.lead("at").over(by) - 1).alias("last")).where(F.col("shared") >= similarity * m - 1e-9)
    laid = runs.select(*one, "shared", F.explode(F.sequence("at", "last")).alias("at"))
    held = F.least(F.col("at") + m, F.col("size") - F.col("k") + 1) - F.greatest("at", F.lit(0))
    return laid.where(F.col("shared") * (1 + similarity) >= similarity * (m + held) - 1e-9).select(*one, "at")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document and item it holds: id, item, start (word), n_words, distance (bits), similarity.

    Of several places the most similar counts, then the first. Documents or items without words
    (null, empty) match nothing. Items of fewer than ``words`` words are one shingle. Repeated rows
    give one result per id and item; a null id is reported as null. Empty tables give no rows.
    """
    bench = written(items.select(F.col(item_col).alias("item"), normal_words(F.col(item_text_col)).alias("w")).where("size(w) > 0").distinct())
    sizes = [words] + sorted(r[0] for r in bench.where(F.size("w") < words).select(F.size("w")).distinct().collect())  # at most ``words`` values
    text = docs.select(F.col(id_col).alias("id"), normal_words(F.col(text_col)).alias("w"), F.xxhash64(F.col(text_col).cast("string")).alias("t"))
    few = (bench.agg(F.sum(F.size("w"))).first()[0] or 0) <= SENT_SHINGLES
    hits = None
    for k in sizes:
        some = bench.where(F.size("w") >= k if k == words else F.size("w") == k)
        seeds = some.select(F.size("w").alias("n_words"), F.explode(word_shingles(F.col("w"), k)).alias("h")).distinct()
        shingles = text.select("id", "t", F.posexplode(word_shingles(F.col("w"), k, True)).alias("i", "s")).select("id", "t", "i", "s.h", "s.size")
        met = shingles.join(F.broadcast(seeds) if few else seeds, "h")
        met = met.select("id", "t", "size", "n_words", F.lit(k).alias("k"), "i").distinct()
        hits = met if hits is None else hits.union(met)
    begin = F.greatest("at", F.lit(0))  # windows at the ends of a text are shorter
    hits = written(starts(hits, similarity).select("id", "t", begin.alias("start"), (F.least(F.col("at") + F.col("n_words"), "size") - begin).alias("length"), "n_words", "k").distinct())
    places = hits.groupBy(F.col("id").alias("hit"), F.col("t").alias("hit_t")).agg(F.collect_list(F.struct("start", "length", "n_words", "k")).alias("places"))
    places = F.broadcast(places) if hits.count() <= SENT_PLACES else places

    def cut(w: Column) -> Column:  # the words bound as in word_shingles, and not carried through the explode
        return F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["n_words"].alias("n_words"), p["k"].alias("k"), F.slice(w, p["start"] + 1, p["length"]).alias("words")))
    held = text.join(places, F.col("id").eqNullSafe(F.col("hit")) & (F.col("t") == F.col("hit_t"))).select(
        "id", F.explode(F.get(F.transform(F.array("w"), cut), 0)).alias("p")).select("id", "p.*")
    held = written(held)
    shingled = F.lit(None).cast("array<bigint>")
    for k in sizes:
        shingled = F.when(F.col("k") == k, word_shingles(F.col("words"), k)).otherwise(shingled)
    found = written(held.select("id", "start", "n_words", "k", shingled.alias("window")).withColumn("own", F.xxhash64("window")))
    found = written(found.select("*", simhash(F.col("window")).alias("fingerprint"), numbered(F.col("window")).alias("window_bag")).drop("window"))

    items_ = bench.select("item", "w", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(words)).alias("k"))
    marked = F.lit(None).cast("array<bigint>")
    for k in sizes:
        marked = F.when(F.col("k") == k, word_shingles(F.col("w"), k)).otherwise(marked)
    marks = written(written(items_.select("item", "n_words", "k", marked.alias("item_shingles"))).select("*", simhash(F.col("item_shingles")).alias("fingerprint"), numbered(F.col("item_shingles")).alias("item_bag")))
    near = [m for m in range(1 << BITS) if m.bit_count() <= PROBE]
    probes = marks.select("item", "n_words", "k", F.col("fingerprint").alias("mark"), F.explode(blocks(F.col("fingerprint"))).alias("b")).select(
        "item", "n_words", "k", "mark", "b.block", F.explode(F.transform(F.array(*map(F.lit, near)), lambda m: F.col("b.value").bitwiseXOR(m.cast("long")))).alias("value"))
    keys = found.select("id", "start", "n_words", "k", "own", "fingerprint", F.explode(blocks(F.col("fingerprint"))).alias("b")).select(
        "id", "start", "n_words", "k", "own", "fingerprint", "b.block", "b.value")
    near_by = (keys.join(probes, ["n_words", "k", "block", "value"])
               .withColumn("distance", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("mark")))).where(F.col("distance") <= RADIUS)
               .select("id", "start", "n_words", "k", "own", "item", "distance").distinct())
    near_by = written(near_by)

    place = ["id", "start", "n_words", "k", "own", "item", "distance"]
    pair = near_by.join(found.select(F.col("id").alias("i2"), F.col("start").alias("s2"), F.col("n_words").alias("n2"), F.col("k").alias("k2"), F.col("own").alias("o2"), "window_bag"),
                        F.col("id").eqNullSafe(F.col("i2")) & (F.col("start") == F.col("s2")) & (F.col("n_words") == F.col("n2")) & (F.col("k") == F.col("k2")) & (F.col("own") == F.col("o2")))
    pair = pair.join(marks.select(F.col("item").alias("it"), F.col("n_words").alias("n3"), "item_bag"), F.col("item").eqNullSafe(F.col("it")) & (F.col("n_words") == F.col("n3")))
    # sum of the smaller counts; that of the larger ones is what remains of both sizes
    scored = pair.withColumn("both", F.size(F.array_intersect("window_bag", "item_bag"))).select(
        *place, (F.col("both") / (F.size("window_bag") + F.size("item_bag") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= similarity)
    best = scored.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words", (-F.col("distance")).alias("d"))).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("m.s")).cast("long").alias("start"), F.col("m.n_words").cast("long").alias("n_words"),
                       (-F.col("m.d")).cast("long").alias("distance"), F.col("m.similarity").alias("similarity"))

