"""Column helpers: ratios, bands, labels, guarded durations, Wilson interval, text cleanup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shipshape import config as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """Ratio of totals as DOUBLE; NULL when the denominator is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def count_if(cond: Column) -> Column:
    """count(*) FILTER (WHERE cond) as BIGINT; NULL conditions count as false."""
    return F.count_if(F.coalesce(cond, F.lit(False))).cast("bigint")


def varies(c: Column | str) -> Column:
    """``count(DISTINCT c) > 1`` as ``min(c) <> max(c)``: two partial aggregates instead of a distinct
    aggregation (several distinct counts in one ``agg`` would make Spark plan an Expand). NULLs are
    ignored by both forms; an all-NULL group is false in both."""
    return F.min(col(c)) != F.max(col(c))


def avg_if(cond: Column, value: Column | str) -> Column:
    return F.avg(F.when(cond, col(value)).cast("double"))


def median_if(cond: Column, value: Column | str) -> Column:
    return F.median(F.when(cond, col(value)).cast("double"))


def days_between(start: Column, end: Column) -> Column:
    """Calendar days end - start as BIGINT."""
    return F.datediff(end, start).cast("bigint")


def guarded_days(start_ts: Column, end_ts: Column, start_date: Column, end_date: Column,
                 extra: Column | None = None) -> Column:
    """Days between two dates, NULL when the end timestamp lies before the start (unreliable)."""
    cond = end_ts >= start_ts
    if extra is not None:
        cond = extra & cond
    return F.when(cond, days_between(start_date, end_date))


def band(value: Column, edges: Sequence[tuple[float | None, float | None, str]], other: str | None = None) -> Column:
    """Label numeric bands; each edge is (low, high, label) inclusive, None = open."""
    expr = None
    for lo, hi, label in edges:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (value >= lo)
        if hi is not None:
            cond = cond & (value <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(other)) if other is not None else expr


def label_sort(label: Column, order: Sequence[str]) -> Column:
    """Companion sort key for a label (1-based position in ``order``)."""
    expr = None
    for i, name in enumerate(order, start=1):
        expr = F.when(label == name, F.lit(i)) if expr is None else expr.when(label == name, F.lit(i))
    return expr.cast("bigint")


def wilson(successes: Column | str, total: Column | str, z: float = C.Z_95) -> tuple[Column, Column]:
    """Wilson score interval at ``z``; NULLs when total is 0, bounds clamped to [0, 1]."""
    k = col(successes).cast("double")
    n = col(total).cast("double")
    p = F.try_divide(k, n)
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    ok = n > 0
    low = F.when(ok, F.greatest(F.lit(0.0), centre - half))
    high = F.when(ok, F.least(F.lit(1.0), centre + half))
    return low, high


# --- fixed value: the Unicode space separators (category Zs), stripped by trim ---------------------
SPACE_SEPARATORS = ("\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                    "\u202f\u205f\u3000")


def unicode_trim(c: Column) -> Column:
    """Strip leading/trailing spaces, Unicode space separators included (not tabs or newlines).

    Set-based ``trim`` walks in from both ends only; a regex anchored at the end would scan the
    whole text.
    """
    return F.trim(c, F.lit(SPACE_SEPARATORS))


def blank_to_null(c: Column) -> Column:
    """Spaces-only text -> NULL, else the trimmed text."""
    return F.nullif(unicode_trim(c), F.lit(""))


def has_text(c: Column) -> Column:
    """``blank_to_null(c) IS NOT NULL`` without building the trimmed copy: some character is not a
    space separator (the search stops at the first one, normally the first character)."""
    return F.coalesce(c.rlike(r"[^\p{Zs}]"), F.lit(False))


def strip_white_space(c: Column) -> Column:
    """Remove white space of every script (line breaks and no-break spaces too) from both ends."""
    return F.regexp_replace(c, rf"\A[{C.WHITE_SPACE}]+|[{C.WHITE_SPACE}]+\z", "")


def squash_spaces(c: Column) -> Column:
    """Collapse runs of white space of every script to one space and trim."""
    return F.trim(F.regexp_replace(c, rf"[{C.WHITE_SPACE}]+", " "))


def shorten(text: Column, most: int = 40) -> Column:
    """F16: texts longer than ``most`` are cut to that length, dots included."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def about(x: Column) -> Column:
    """to the nearest hundred, ties to the even one."""
    return F.bround(x, -2)


def null_splitting_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left.join(right, key, "left")`` whose rows without a key go round the exchange.

    A NULL key matches nothing, but an outer join must keep its rows, and a shuffle sends them all to
    one task. Here they are unioned with NULLs for the columns of ``right``. ``key`` stays in the
    place it has in ``left``.
    """
    more = [c for c in right.columns if c != key]
    matched = left.where(F.col(key).isNotNull()).join(right.where(F.col(key).isNotNull()), key, "left").select(*left.columns, *more)
    types = dict(right.dtypes)
    bare = left.where(F.col(key).isNull()).select(*left.columns, *[F.lit(None).cast(types[c]).alias(c) for c in more])
    return matched.unionByName(bare)


def one_row(df: DataFrame) -> Column:
    """A one-row result bound once, as a struct-valued scalar subquery: ``one_row(base)["low"]``.

    Reading several fields of one subquery computes the row once; a scalar subquery per field
    would be planned and computed once per field (each prunes the row to a different column).
    """
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()
