"""Column helpers against hand values (published formula checks)."""

from pyspark.sql import functions as F

from shipshape.functions.exprs import ratio, wilson
from shipshape.operators import sampling


def test_wilson_published_values(spark):
    lo, hi = wilson(F.lit(44), F.lit(54))
    lo2, hi2 = wilson(F.lit(103), F.lit(6341))
    r = spark.range(1).select(lo.alias("a"), hi.alias("b"), lo2.alias("c"), hi2.alias("d")).first()
    assert round(r.a, 4) == 0.6916 and round(r.b, 4) == 0.8962
    assert round(r.c, 4) == 0.0134 and round(r.d, 4) == 0.0197


def test_wilson_zero_total_is_null(spark):
    lo, hi = wilson(F.lit(0), F.lit(0))
    r = spark.range(1).select(lo.alias("a"), hi.alias("b")).first()
    assert r.a is None and r.b is None


def test_ratio_divide_by_zero_is_null(spark):
    r = spark.range(1).select(ratio(F.lit(1), F.lit(0)).alias("x")).first()
    assert r.x is None


def test_largest_remainder_published_allocation(spark):
    sizes = spark.createDataFrame([("a", 4483), ("b", 2730), ("c", 1897), ("d", 1526)],
                                  "delivery_group string, frame_size long")
    got = {r.delivery_group: r.allocated for r in sampling.allocation(sizes, 300).collect()}
    assert got == {"a": 126, "b": 77, "c": 54, "d": 43}
    assert sum(got.values()) == 300


def test_mask_phone_runs(spark):
    df = spark.createDataFrame([("call 11 98765-4321 now",), ("price 12.50 on 2018-01-02",)], "t string")
    out = [r.m for r in df.select(sampling.mask_text(F.col("t")).alias("m")).collect()]
    assert out[0] == "call [number removed] now"
    assert out[1] == "price 12.50 on 2018-01-02"


def test_text_helpers_unicode_spaces(spark):
    from pyspark.sql import functions as F

    from shipshape.functions.exprs import blank_to_null, has_text, unicode_trim
    rows = [("  hello　",), ("   ",), ("\tx\n",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(unicode_trim(F.col("t")).alias("u"), blank_to_null(F.col("t")).alias("b"),
                    has_text(F.col("t")).alias("h")).collect()
    assert [r.u for r in got] == ["hello", "", "\tx\n", "", None]      # tabs/newlines are not spaces
    assert [r.b for r in got] == ["hello", None, "\tx\n", None, None]
    assert [r.h for r in got] == [True, False, True, False, False]       # has_text == blank_to_null IS NOT NULL


def test_varies_equals_distinct_count_above_one(spark):
    from pyspark.sql import functions as F

    from shipshape.functions.exprs import varies
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (3, "a"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "k int, v string")
    got = df.groupBy("k").agg(varies("v").alias("x"), (F.count_distinct("v") > 1).alias("y")).collect()
    assert all(bool(r.x) == r.y for r in got) and len(got) == 4


def test_one_row_binds_fields(spark):
    from pyspark.sql import functions as F

    from shipshape.functions.exprs import one_row
    base = spark.range(10).agg(F.sum("id").alias("s"), F.count(F.lit(1)).alias("n"))
    r = one_row(base)
    assert spark.range(1).select(r["s"].alias("s"), r["n"].alias("n")).first() == (45, 10)
