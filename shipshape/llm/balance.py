"""Mixing to target weights by entropy balancing (operator 1).

Rates exp(lambda) per document tilt the corpus as little as possible (in relative entropy, weighted
by size) so that the sizes of each class meet its target. The convex dual is solved by Newton
steps: for each constraint column in turn the gradient (target less tilted size) and the diagonal
Hessian block (tilted size) are summed per class, and the step is added to the classes' multipliers.
Documents enter only through sums per combination of classes. Rates are rounded into whole copies:
at random by a hash of the id, then corrected class by class along a second hash order, with prefix
sums per bucket and by single best-fitting documents, until the sum is near its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shipshape.llm.common import written

#: Newton stops at this relative error, or when so many rounds brought none of a tenth less (constraints that contradict one another).
TOLERANCE, STALE = 1e-9, 6
#: Rows of one prefix-sum bucket.
BUCKET_ROWS = 5000
#: Correction ends when every class is this near to its target (relative), or STALE passes brought the worst no tenth nearer.
NEAR = 0.002


class Progress:
    """Whether to go on: until ``enough`` is reached, and as long as the error falls by a tenth within STALE looks."""

    def __init__(self, enough: float):
        self.enough, self.best, self.idle = enough, float("inf"), 0

    def done(self, error: float) -> bool:
        self.idle = 0 if error < 0.9 * self.best else self.idle + 1
        self.best = min(self.best, error)
        return error < self.enough or self.idle >= STALE


def sized(docs: DataFrame, id_col: str, text_col: str, class_col: str) -> DataFrame:
    """id, class, size (number of words ``[^\\x20\\x09-\\x0D]+``; null text: 0) of every row."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(class_col).alias("class"), size.alias("size"),
                       F.xxhash64(F.col(id_col), F.col(class_col), F.col(text_col)).alias("row"))


def class_targets(rows: DataFrame, weights: list[int], most: int) -> DataFrame:
    """class, class_size, target: classes by code point (null last) weigh ``weights`` in turn and share all sizes.

    A target stops at ``most`` times its class's size; the excess is shared by weight among the
    others until none is above. Works on one row per class.
    """
    order = Window.orderBy(F.col("class").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = written(rows.groupBy("class").agg(F.sum("size").cast("long").alias("class_size"), F.count("*").alias("n"))
                .withColumn("weight", weight.cast("double")).withColumn("full", F.lit(False)))
    while True:
        left = t.agg((F.sum("class_size") - F.coalesce(F.sum(F.when(F.col("full"), F.col("class_size") * most)), F.lit(0))).alias("size"),
                     F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight"), F.sum(F.col("full").cast("int")).alias("full")).first()
        share = F.lit(float(left["size"] or 0)) * F.col("weight") / F.lit(float(left["weight"] or 1))
        t = t.withColumn("target", F.when(F.col("full") | (share > F.col("class_size") * most), (F.col("class_size") * most).cast("double")).otherwise(share))
        above = ~F.col("full") & (share > F.col("class_size") * most)
        if not t.where(above).limit(1).count():
            return written(t.select("class", "class_size", "n", "target"))
        t = written(t.withColumn("full", F.col("full") | above))


def tilt(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Solve the dual: ``cells`` (class columns, size) gets ``rate``; ``targets``: column -> (class, target).

    Classes are matched null-safely; a class without a target, or with target or size 0, has rate 0.
    """
    cells = written(cells.withColumn("lambda", F.lit(0.0)))
    progress, worst = Progress(TOLERANCE), float("inf")
    while not progress.done(worst):
        worst = 0.0
        for col, wanted in targets.items():
            tilted = cells.groupBy(col).agg(F.sum(F.col("size") * F.exp("lambda")).alias("g")).withColumnRenamed(col, "k")
            goal = wanted.select(F.col("class").alias("k2"), F.col("target").cast("double").alias("t"))
            step = tilted.join(goal, F.col("k").eqNullSafe(F.col("k2")), "left").select(
                "k", F.when((F.col("t") > 0) & (F.col("g") > 0), (F.col("t") - F.col("g")) / F.col("g")).alias("step"))
            cells = written(cells.drop("step").join(step, F.col(col).eqNullSafe(F.col("k")), "left").drop("k")
                            .withColumn("lambda", F.col("lambda") + F.greatest(F.least("step", F.lit(1.0)), F.lit(-1.0))))
            worst = max(worst, cells.agg(F.max(F.abs("step"))).first()[0] or 0.0)
    return cells.withColumn("rate", F.coalesce(F.exp("lambda"), F.lit(0.0))).drop("lambda", "step")


def _unit(*cols):
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))


def rounded(rows: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """Whole copies (0..most) of every row of (id, class, size, row, rate); ``classes``: class, n, target."""
    now = rows.withColumn("u", _unit("row", F.lit(7)))
    now = now.withColumn("copies", F.least(F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("int"), F.lit(most)).cast("long"))
    now, progress, p = written(now), Progress(NEAR), -1
    while True:
        p += 1
        taken = now.groupBy("class").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
        gap = written(taken.join(classes.select(F.col("class").alias("c2"), "n", "target"), F.col("class").eqNullSafe(F.col("c2")))
                      .select("c2", (F.col("target") - F.col("taken")).alias("gap"), F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("parts"), "target"))
        if progress.done(gap.agg(F.max(F.abs("gap") / F.greatest("target", F.lit(1.0)))).first()[0] or 0.0):
            break
        open_ = now.join(gap, F.col("class").eqNullSafe(F.col("c2"))).where("size > 0").where(
            F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0))
        if p % 2:  # one row per class: the one whose size is nearest to the gap, if that closes more than it opens
            chosen = (open_.where(F.col("size") < 2 * F.abs("gap")).groupBy("class", "gap")
                      .agg(F.min_by(F.struct("row", "id"), F.struct(F.abs(F.col("size") - F.abs("gap")), "row", "id")).alias("best")).select("gap", "best.row", "best.id"))
        else:  # rows along a hash order, as far as they fit
            open_ = open_.where(F.col("size") <= F.abs("gap")).withColumn("v", _unit("row", F.lit(100 + p))).withColumn("bucket", F.floor(F.col("v") * F.col("parts")))
            before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            sums = open_.groupBy("class", "bucket", "gap").agg(F.sum("size").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
            sums = sums.where(F.col("before") < F.abs("gap")).select(F.col("class").alias("c3"), F.col("bucket").alias("b3"), "before")
            within = Window.partitionBy("class", "bucket").orderBy("v", "row", "id").rowsBetween(Window.unboundedPreceding, 0)
            chosen = (open_.join(sums, F.col("class").eqNullSafe(F.col("c3")) & (F.col("bucket") == F.col("b3")))
                      .withColumn("upto", F.col("before") + F.sum("size").over(within)).where(F.col("upto") <= F.abs("gap")))
        chosen = chosen.select(F.col("row").alias("r4"), F.col("id").alias("i4"), F.signum("gap").cast("long").alias("more"))
        now = written(now.join(chosen, (F.col("row") == F.col("r4")) & F.col("id").eqNullSafe(F.col("i4")), "left")
                      .withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("r4", "i4", "more"))
    return now


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per distinct (id, class, text): id, class, row (hash), size, rows, class_size, target, copies per row.

    A null class is a class of its own, last in order; texts without words have size 0 and are not
    taken. Rows that repeat id, class and text are decided together and each get the same copies.
    An empty table gives an empty result. The same input gives the same mix on every run.
    """
    rows = sized(docs, id_col, text_col, class_col).groupBy("id", "class", "row").agg(F.first("size").alias("one"), F.count("*").alias("rows"))
    rows = written(rows.withColumn("size", F.col("one") * F.col("rows")))
    targets = class_targets(rows, list(weights), most)
    cells = tilt(targets.select("class", F.col("class_size").alias("size")), {"class": targets})
    rate = cells.select(F.col("class").alias("c1"), "rate")
    rows = rows.join(rate, F.col("class").eqNullSafe(F.col("c1"))).drop("c1")
    done = rounded(rows, targets, most)
    return done.join(targets.select(F.col("class").alias("c5"), "class_size", "target"), F.col("class").eqNullSafe(F.col("c5"))).select(
        "id", "class", "row", F.col("one").alias("size"), "rows", "class_size", "target", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str = "source", **options) -> DataFrame:
    """The rows of the mix: every row of ``docs`` as often as ``mix`` takes it, with all its columns."""
    plan = mix(docs, id_col, text_col, class_col, **options).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("copies").alias("__copies")).where("__copies > 0")
    keyed = docs.withColumn("__key", F.xxhash64(F.col(id_col), F.col(class_col), F.col(text_col)))
    out = keyed.join(plan, (F.col("__key") == F.col("__row")) & F.col(id_col).eqNullSafe(F.col("__id")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
