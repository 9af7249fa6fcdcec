"""Exact ranking operators that never put one group (or the whole table) into a single task.

``sequence_in_group`` is ``row_number() OVER (PARTITION BY g ORDER BY o)``; ``global_row_number``
and ``ntile`` are the unpartitioned variants, ``running_total`` is a running sum. A plain window
would send every row of one group to one task (and every row to one task when there is no
PARTITION BY). Here the order of (g, o) is cut by explicit splitters: keys of a sample, chosen once
and held as a small sorted array. Every row gets a bucket column, the number of splitters up to its
key, by binary search; a window numbers the rows of a bucket, and what earlier buckets hold of a
bucket's first group is added from a summary of one row per bucket.

The bucket is a function of the row alone. Rows and summary agree however Spark plans them (with or
without exchange reuse or adaptive plans, after lost executors), and no Python worker is involved.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Rows of one bucket, about; a smaller table is one bucket.
BUCKET_ROWS = 1_000_000
#: Sampled rows for each bucket.
SAMPLE = 64
_BUCKET, _LOCAL, _KEY, _NULL, _SEP = "_rk_bucket", "_rk_local", "_rk_k", "\u0002", "\u0001"


@dataclass(frozen=True)
class Desc:
    """An order column that falls, NULLs last."""

    column: Column


def desc(c: Column | str) -> Desc:
    return Desc(F.col(c) if isinstance(c, str) else c)


def _falling(c: Column, kind: T.DataType) -> list[Column]:
    """Columns whose rising order is the falling order of ``c`` with NULLs last."""
    if isinstance(kind, T.BooleanType):
        value = (~c).cast("int")
    elif isinstance(kind, T.DateType):
        value = -F.unix_date(c)
    elif isinstance(kind, T.TimestampType):
        value = -F.unix_micros(c)
    elif isinstance(kind, T.TimestampNTZType):
        return [c.isNull(), -F.unix_date(c.cast("date")), -(F.hour(c) * 3600 + F.minute(c) * 60) - F.date_part(F.lit("SECONDS"), c)]
    elif isinstance(kind, T.LongType):
        value = -c.cast("decimal(20,0)")  # the smallest long has no negative
    elif isinstance(kind, T.NumericType):
        value = -c
    else:
        raise TypeError(f"no falling order for {kind.simpleString()}")
    return [c.isNull(), value]


def _rising(df: DataFrame, order: Sequence[Column | str | Desc]) -> list[Column]:
    """The order as columns that all rise, NULLs first."""
    out = []
    for o in order:
        if isinstance(o, Desc):
            out += _falling(o.column, df.select(o.column.alias("c")).schema[0].dataType)
        else:
            out.append(F.col(o) if isinstance(o, str) else o)
    return out


def _spelled(rows: list, i: int, kind: T.DataType) -> Column:
    """The i-th values of some rows as one constant array: spelled in one string, cast to their type."""
    if isinstance(kind, T.StringType) and any(_SEP in (r[i] or "") or r[i] == _NULL for r in rows):
        return F.array(*[F.lit(r[i]) for r in rows])
    text = _SEP.join(_NULL if r[i] is None else str(r[i]) for r in rows)
    values = F.transform(F.split(F.lit(text), _SEP), lambda x: F.nullif(x, F.lit(_NULL)))
    return values.cast(T.ArrayType(kind))


def bucketed(df: DataFrame, order: Sequence[Column | str | Desc], partitions: int | None = None) -> tuple[DataFrame, list[Column], int, int]:
    """``df`` with its bucket column and rising key columns; the keys, the number of buckets, the number of rows.

    Two small jobs come first: one counts the rows, one fetches the sampled keys (by hash, so every
    run takes the same), of which every ``SAMPLE``-th in order is a splitter. A sample that is itself
    too large for a task is numbered by the same operator.
    """
    keys = _rising(df, order)
    named = [k.alias(f"{_KEY}{i}") for i, k in enumerate(keys)]
    rows = df.count()
    buckets = partitions or -(-rows // BUCKET_ROWS)
    keyed = df.select("*", *named)
    names = [f"{_KEY}{i}" for i in range(len(keys))]
    if buckets <= 1 or not rows:
        return keyed.withColumn(_BUCKET, F.lit(0)), [F.col(n) for n in names], 1, rows
    part = min(1.0, buckets * SAMPLE / rows)
    # another hash at each level
    hit = F.xxhash64(F.lit(rows), *keys).bitwiseAND(F.lit((1 << 32) - 1)) < F.lit(int(part * (1 << 32)))
    sample = df.select(*named).where(hit) if part < 1 else df.select(*named)
    numbered, total = _numbered(sample, names)
    step = max(1, total // buckets)
    splitters = sorted(numbered.where((F.col(_LOCAL) % step == 0) & (F.col(_LOCAL) < F.lit(total))).collect(), key=lambda r: r[_LOCAL])
    if not splitters:
        return keyed.withColumn(_BUCKET, F.lit(0)), [F.col(n) for n in names], 1, rows
    kinds = [keyed.schema[n].dataType for n in names]
    held = F.arrays_zip(*[_spelled(splitters, i, k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])
    held = held.cast(T.ArrayType(T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])))
    key = F.struct(*names)
    found = F.lit(0)  # splitters up to the key: binary search by falling powers of two
    for power in reversed(range(len(splitters).bit_length())):
        at = found + (1 << power)
        found = F.when(F.get(held, at - 1) <= key, at).otherwise(found)
        keyed = keyed.withColumn(f"{_BUCKET}{power}", found)
        found = F.col(f"{_BUCKET}{power}")
    keyed = keyed.withColumn(_BUCKET, found).drop(*[f"{_BUCKET}{p}" for p in range(len(splitters).bit_length())])
    return keyed, [F.col(n) for n in names], len(splitters) + 1, rows


def _numbered(sample: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
    """The sampled keys with their place in order, and their number."""
    total = sample.count()
    if total <= BUCKET_ROWS:
        return sample.withColumn(_LOCAL, F.row_number().over(Window.orderBy(*names)).cast("bigint")), total
    inner = sample.select(*[F.col(n).alias(f"s{n}") for n in names])
    done = global_row_number(inner, [f"s{n}" for n in names], "_rk_place")
    return done.select(*[F.col(f"s{n}").alias(n) for n in names], F.col("_rk_place").alias(_LOCAL)), total


def sequence_in_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str | Desc],
                      out_col: str = "rn", partitions: int | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by group_cols order by order_cols)``, skew-safe.

    ``order_cols`` must be a total order inside each group (add a unique tie-break). ``partitions``
    sets the number of buckets (default: by the rows).
    """
    return _sequence(df, group_cols, order_cols, out_col, partitions)[0]


def _sequence(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str | Desc], out_col: str,
              partitions: int | None) -> tuple[DataFrame, int]:
    """The numbered rows, and the number of rows."""
    g = list(group_cols)
    keyed, keys, buckets, rows = bucketed(df, [*g, *order_cols], partitions)
    local = keyed.withColumn(_LOCAL, F.row_number().over(Window.partitionBy(_BUCKET, *g).orderBy(*keys)).cast("bigint"))
    if buckets == 1:
        return local.withColumn(out_col, F.col(_LOCAL)).select(*df.columns, out_col), rows
    # the last group of each bucket and its rows there: one row per bucket
    last = F.max(F.struct(*[F.col(c) for c in g], F.col(_LOCAL).alias("_cnt"))).alias("_last")
    summary = local.groupBy(_BUCKET).agg(last).select(_BUCKET, *[F.col(f"_last.{c}").alias(c) for c in g], F.col("_last._cnt").alias("_cnt"))
    by_group = Window.partitionBy(*g).orderBy(_BUCKET) if g else Window.orderBy(_BUCKET)
    offsets = (summary
               .withColumn("_carry", F.sum("_cnt").over(by_group.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("_next", F.lead(_BUCKET).over(Window.orderBy(_BUCKET)))
               .filter(F.col("_next").isNotNull())
               .select(F.col("_next").alias("_o_bucket"), *[F.col(c).alias(f"_o_{c}") for c in g], "_carry"))
    cond = F.col(_BUCKET) == F.col("_o_bucket")
    for c in g:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    out = (local.join(F.broadcast(offsets), cond, "left")
           .withColumn(out_col, (F.col(_LOCAL) + F.coalesce(F.col("_carry"), F.lit(0))).cast("bigint")))
    return out.select(*df.columns, out_col), rows


def global_row_number(df: DataFrame, order_cols: Sequence[Column | str | Desc], out_col: str = "rn",
                      partitions: int | None = None) -> DataFrame:
    """Exact ``row_number() over (order by order_cols)`` without a single-partition window."""
    return sequence_in_group(df, [], order_cols, out_col, partitions)


def ntile(df: DataFrame, buckets: int, order_cols: Sequence[Column | str | Desc], out_col: str = "ntile",
          partitions: int | None = None) -> DataFrame:
    """Exact ``ntile(buckets) over (order by order_cols)`` (first N mod b buckets get one more row)."""
    x, n = _sequence(df, [], order_cols, "_nt_rn", partitions)
    q, rem = divmod(n, buckets)
    big = rem * (q + 1)
    rn = F.col("_nt_rn")
    small = rem + F.floor((rn - big - 1) / max(q, 1)) + 1
    tile = F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1).otherwise(small)
    return x.withColumn(out_col, tile.cast("bigint")).drop("_nt_rn")


def top_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], k: int,
                  out_col: str = "position") -> DataFrame:
    """Rows with ``row_number() <= k`` per group; the literal bound lets Spark plan a partial
    WindowGroupLimit before the shuffle, so each task sends at most k rows per group."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(out_col, F.row_number().over(w).cast("bigint")).filter(F.col(out_col) <= k)


def running_total(df: DataFrame, order_cols: Sequence[Column | str | Desc], weight_col: str, out_col: str = "cum",
                  partitions: int | None = None) -> DataFrame:
    """Exact ``sum(weight) over (order by order_cols rows unbounded preceding)``: summed within each
    bucket, then shifted by the totals of the earlier ones (one row per bucket, broadcast).
    ``order_cols`` must be a total order."""
    keyed, keys, buckets, _ = bucketed(df, order_cols, partitions)
    within = Window.partitionBy(_BUCKET).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumn(_LOCAL, F.sum(weight_col).over(within))
    if buckets == 1:
        return local.withColumn(out_col, F.col(_LOCAL).cast("bigint")).select(*df.columns, out_col)
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (keyed.groupBy(_BUCKET).agg(F.sum(weight_col).alias("_cnt"))
               .select(F.col(_BUCKET).alias("_o_bucket"), F.sum("_cnt").over(before).alias("_carry")))
    out = (local.join(F.broadcast(offsets), F.col(_BUCKET) == F.col("_o_bucket"), "left")
           .withColumn(out_col, (F.col(_LOCAL) + F.coalesce(F.col("_carry"), F.lit(0))).cast("bigint")))
    return out.select(*df.columns, out_col)
