"""The skew-safe ranking operators equal the plain window functions, also with one hot group."""

from pyspark.sql import Window, functions as F

from shipshape.operators import rank
from shipshape.operators.rank import desc, global_row_number, ntile, running_total, sequence_in_group


def _data(spark):
    # one group holds a third of the rows (hot key), the rest is spread
    hot = spark.range(0, 3000).select(F.lit(7).alias("g"), (F.col("id") % 97).alias("o"), F.col("id").alias("id"))
    rest = spark.range(3000, 9000).select((F.col("id") % 50).alias("g"), (F.col("id") % 13).alias("o"), F.col("id"))
    return hot.unionByName(rest)


def test_sequence_in_group_matches_row_number(spark):
    df = _data(spark)
    got = sequence_in_group(df, ["g"], ["o", "id"], "rn", partitions=7)
    w = Window.partitionBy("g").orderBy("o", "id")
    want = df.withColumn("rn", F.row_number().over(w).cast("bigint"))
    assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0
    assert got.count() == df.count()


def test_global_row_number_and_ntile(spark):
    df = _data(spark)
    got = global_row_number(df, [desc("o"), F.col("id")], "rn", partitions=5)
    w = Window.orderBy(F.col("o").desc(), F.col("id"))
    want = df.withColumn("rn", F.row_number().over(w).cast("bigint"))
    assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0
    nt = ntile(df.limit(13), 10, [F.col("id")], "d", partitions=3)
    assert [r.d for r in nt.orderBy("id").collect()] == [1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10]


def test_sequence_with_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "g int, o int")
    got = {(r.g, r.o): r.rn for r in sequence_in_group(df, ["g"], ["o"], "rn", partitions=2).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, (1, 3): 1}


def test_global_row_number_with_empty_partitions(spark):
    df = spark.range(0, 40).select(((F.col("id") * 7) % 40).alias("v"))
    got = global_row_number(df, [desc("v")], "rn", partitions=64)
    assert sorted((r.v, r.rn) for r in got.collect()) == sorted((v, 40 - v) for v in range(40))


def test_exact_quantiles_match_percentile(spark):
    from shipshape.operators.quantiles import quantiles
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    # a hot value holds a third of the rows; the rest are spread with duplicates
    hot = spark.range(0, 3000).select(F.lit(12.5).alias("x"))
    rest = spark.range(3000, 9000).select(((F.col("id") * 37) % 1001 / 4.0).alias("x"))
    df = hot.unionByName(rest).unionByName(spark.createDataFrame([(None,)], "x double"))
    got = quantiles(df, {"x": F.col("x"), "minus": -F.col("x")}, probs).where("measure = 'x'").first().q
    want = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert [round(a, 9) for a in got] == [round(b, 9) for b in want]
    empty = df.filter("x > 1e9")
    assert quantiles(empty, {"x": F.col("x")}, [0.5]).select("n", "q").first() == (0, [None])


def test_numbering_consistent_when_range_bounds_are_sampled(spark):
    # enough rows that the range partitioner samples (bounds would differ between two exchanges):
    # every branch of the operator must see one and the same partitioning
    df = spark.range(0, 120000).select(((F.col("id") * 7919) % 1000).alias("g"), ((F.col("id") * 104729) % 100003).alias("o"),
                                       F.col("id"), (F.col("id") % 3).alias("pad"))
    got = sequence_in_group(df, ["g"], ["o", "id"], "rn", partitions=16)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")).cast("bigint"))
    assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0
    got = global_row_number(df, [desc("o"), F.col("id")], "rn", partitions=16)
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("o").desc(), "id")).cast("bigint"))
    assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0


def test_exact_quantiles_with_sampled_bounds(spark):
    from shipshape.operators.quantiles import quantiles
    probs = [0.001, 0.5, 0.9, 0.999]
    df = spark.range(0, 150000).select((((F.col("id") * 104729) % 99991) / 100.0).alias("x"))
    got = quantiles(df, {"x": F.col("x")}, probs).first().q
    want = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert [round(a, 9) for a in got] == [round(b, 9) for b in want]


def test_quantiles_of_signs_spread_and_hot_values(spark):
    """Negative, zero, tiny and huge values; all rows in one bin; a hot value; several columns at once."""
    from shipshape.operators.quantiles import quantiles
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.range(0, 5000).select(((F.col("id") - 2500) * F.lit(1.7)).alias("a"), (F.pow(F.lit(10.0), F.col("id") % 19 - 9) * F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0)).alias("b"),
                                     (F.lit(1000.0) + F.col("id") / 1e6).alias("c"), F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("d"),
                                     F.when(F.col("id") == 7, 1.0).alias("e"))
    got = {r.measure: r for r in quantiles(df, {c: F.col(c) for c in df.columns}, probs).collect()}
    for c in df.columns:
        want = df.agg(F.percentile(c, F.array(*[F.lit(p) for p in probs])), F.min(c), F.max(c), F.avg(c), F.count(c)).first()
        assert all(abs(x - y) <= 1e-9 * max(1, abs(y)) for x, y in zip(got[c].q, want[0])), c
        assert (got[c].min_value, got[c].max_value, got[c].n) == (want[1], want[2], want[4]) and abs(got[c].mean_value - want[3]) <= 1e-6 * max(1, abs(want[3]))


def test_numbering_does_not_depend_on_the_plan(spark):
    """Exchange reuse off and on, adaptive plans off and on, another number of shuffle partitions, a hot group."""
    hot = spark.range(0, 20000).select(F.lit(7).alias("g"), ((F.col("id") * 104729) % 5003).alias("o"), F.col("id"))
    df = hot.unionByName(spark.range(20000, 60000).select(((F.col("id") * 7919) % 500).alias("g"), ((F.col("id") * 104729) % 100003).alias("o"), F.col("id")))
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")).cast("bigint"))
    for name, value in (("spark.sql.exchange.reuse", "false"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "3")):
        before = spark.conf.get(name)
        spark.conf.set(name, value)
        try:
            got = sequence_in_group(df, ["g"], ["o", "id"], "rn", partitions=16)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "rangepartitioning" not in plan and "Python" not in plan and "InArrow" not in plan
            assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0
        finally:
            spark.conf.set(name, before)


def test_buckets_are_even_and_a_hot_group_is_cut(spark):
    df = spark.range(0, 50000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("g"), "id")
    keyed, _, buckets, rows = rank.bucketed(df, ["g", "id"], 20)
    sizes = [r["count"] for r in keyed.groupBy("_rk_bucket").count().collect()]
    assert rows == 50000 and buckets == len(sizes) and 15 <= buckets <= 21 and max(sizes) < 3 * 50000 / 20


def test_falling_orders_of_all_kinds(spark):
    """NULLs last, smallest long, dates, times, decimals, booleans, strings with odd signs rising."""
    df = spark.range(0, 400).select(
        "id", F.when(F.col("id") % 7 > 0, F.col("id") % 5 - 2).alias("i"), F.when(F.col("id") % 11 > 0, F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 13).cast("int"))).alias("d"),
        F.timestamp_micros(F.col("id") % 9 * 1_000_003).cast("timestamp_ntz").alias("t"), ((F.col("id") % 17) / 4).cast("decimal(9,2)").alias("m"), (F.col("id") % 2 == 0).alias("b"),
        F.when(F.col("id") == 3, -(1 << 63)).otherwise(F.col("id") % 3).alias("l"), F.element_at(F.array(F.lit("x\u0001y"), F.lit("\u0002"), F.lit(""), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("s"),
        F.when(F.col("id") % 6 > 0, (F.col("id") % 19) / 3.0).alias("x"))
    for c in ("i", "d", "t", "m", "b", "l", "x"):
        got = {r.id: r.rn for r in global_row_number(df, [desc(c), "s", "id"], "rn", partitions=9).collect()}
        want = {r.id: r.rn for r in df.select("id", F.row_number().over(Window.orderBy(F.col(c).desc(), "s", "id")).alias("rn")).collect()}
        assert got == want, c


def test_large_samples_are_numbered_in_turn(spark, monkeypatch):
    monkeypatch.setattr(rank, "BUCKET_ROWS", 300)
    df = spark.range(0, 5000).select(((F.col("id") * 37) % 1000).alias("v"), "id")
    got = {r.id: (r.rn, r.cum) for r in running_total(global_row_number(df, ["v", "id"], "rn"), ["v", "id"], "v", "cum").collect()}
    w = Window.orderBy("v", "id")
    want = {r.id: (r.rn, r.cum) for r in df.select("id", F.row_number().over(w).alias("rn"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum")).collect()}
    assert got == want


def test_ntile_matches_window_on_large_input(spark):
    df = spark.range(0, 100003).select(((F.col("id") * 104729) % 99991).alias("o"), F.col("id"))
    got = ntile(df, 10, [desc("o"), F.col("id")], "d", partitions=16)
    want = df.withColumn("d", F.ntile(10).over(Window.orderBy(F.col("o").desc(), "id")).cast("bigint"))
    assert got.select("id", "d").exceptAll(want.select("id", "d")).count() == 0
