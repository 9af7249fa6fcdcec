"""Exact interpolated quantiles of several columns at once, by narrowing histograms.

Pass 1 counts the rows of each column in order-preserving bins (a few thousand: bins are equal steps
of the signed logarithm, so their number depends on the range of the values, not on the rows) and
takes minimum, maximum and sum along. The bins' running counts tell which bins hold a wanted rank.
Pass 2 keeps only the rows of those bins, counted per distinct value, and picks the values of the
wanted ranks. No value range is sorted as a whole, and a hot value is one row of either count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shipshape.operators.rank import running_total

#: Bins for each unit of the natural logarithm.
BINS = 256


def order_bin(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises (the logarithm is semi-monotonic)."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * BINS).cast("bigint")


def quantiles(df: DataFrame, values: dict[str, Column], probs: Sequence[float], bins=order_bin) -> DataFrame:
    """One row per measure: measure, n, min_value, max_value, mean_value, q (array in the order of ``probs``).

    NULLs count nowhere; a measure without values has n 0 and NULLs. Interpolates like ``percentile``:
    at rank (n - 1) * p between its two neighbours.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), v.cast("double").alias("v")) for name, v in values.items()])
    long = df.select(F.explode(pairs).alias("x")).select("x.*").where(F.col("v").isNotNull()).withColumn("bin", bins(F.col("v")))
    hist = long.groupBy("measure", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("sum"))
    facts, wanted, bins_, passed = {}, [], [], 0
    rows = sorted(hist.collect(), key=lambda r: (r["measure"], r["bin"]))  # bounded by the range of doubles, a few thousand for money
    for name in sorted(values):
        own = [r for r in rows if r["measure"] == name]
        total = sum(r["n"] for r in own)
        facts[name] = (name, total, min(r["low"] for r in own), max(r["high"] for r in own), math.fsum(r["sum"] for r in own) / total) if own else (name, 0, None, None, None)
        at = [(total - 1) * float(p) for p in probs]
        ranks = sorted({k for x in at for k in (math.floor(x), math.ceil(x))}) if own else []
        start = 0
        for r in own:
            held = [k for k in ranks if start <= k < start + r["n"]]
            if held:
                bins_.append((name, r["bin"], start - passed))  # rank of the bin's first row, less the rows of the bins read before it
                wanted += [(name, r["bin"], k) for k in held]
                passed += r["n"]
            start += r["n"]
    spark = df.sparkSession
    shift = F.broadcast(spark.createDataFrame(bins_, "measure string, bin long, shift long"))  # at most two bins for each measure and probability
    inside = long.join(shift.select("measure", "bin"), ["measure", "bin"], "left_semi").groupBy("measure", "bin", "v").agg(F.count(F.lit(1)).alias("m"))
    cum = running_total(inside, ["measure", "bin", "v"], "m", "upto").join(shift, ["measure", "bin"])
    end = F.col("shift") + F.col("upto")
    cum = cum.select("measure", "bin", "v", (end - F.col("m")).alias("first"), end.alias("end"))
    found = cum.join(F.broadcast(spark.createDataFrame(wanted, "measure string, bin long, rank long")), ["measure", "bin"]).where(
        (F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("end"))).groupBy("measure").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    whole = spark.createDataFrame([facts[name] for name in values], "measure string, n long, min_value double, max_value double, mean_value double")

    def between(p: float) -> Column:
        x = (F.col("n") - 1).cast("double") * F.lit(float(p))
        low, high = F.try_element_at("at", F.floor(x).cast("long")), F.try_element_at("at", F.ceil(x).cast("long"))
        return low + (x - F.floor(x)) * (high - low)
    return whole.join(found, "measure", "left").select("measure", "n", "min_value", "max_value", "mean_value", F.array(*[between(p) for p in probs]).alias("q"))
