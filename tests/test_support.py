"""Minimum supports: a cut leaves out only what has fewer orders than the reference asks for (30, 300, 500)."""

from pyspark.sql import functions as F

from shipshape.operators import cuts


def _categories(spark):
    rows = [("few", 499, 9.0, 0.1, 0.9, 0.9), ("edge", 500, 9.0, 0.1, 0.5, 0.2), ("some", 900, 9.0, 0.1, 0.4, 0.4), ("many", 2000, 9.0, 0.1, 0.3, 0.6)]
    return spark.createDataFrame(rows, "category_en string, orders bigint, gmv double, gmv_share double, low_share double, low_share_clean double")


def test_worst_categories_of_500_orders(spark):
    assert [r.category_en for r in cuts.worst_categories(_categories(spark)).collect()] == ["edge", "some", "many"]


def test_clean_range_of_500_orders(spark):
    r = cuts.category_clean_range(_categories(spark)).first()
    assert (r.categories, r.categories_min, r.clean_min, r.clean_median, r.clean_max) == (4, 3, 0.2, 0.4, 0.6)


def test_flags_of_500_orders(spark):
    got = {r.category_en: (r.is_flagged, r.is_worst) for r in cuts.category_flags(_categories(spark), F.lit(0.45)).collect()}
    assert got == {"edge": (True, True), "some": (False, False), "many": (False, False)}


def _sellers(spark):
    rows = [(1, 29, 29, 29, 29, 29), (2, 30, 30, 20, 30, 10), (3, 300, 300, 30, 300, 30), (4, 500, 500, 10, 500, 10)]
    return spark.createDataFrame(rows, "seller_id bigint, orders bigint, delivered bigint, late bigint, reviewed bigint, low bigint")


def test_late_deciles_of_30_orders(spark):
    got = {r.decile: (r.sellers, r.orders, r.late) for r in cuts.seller_deciles_late(_sellers(spark)).collect()}
    assert got == {1: (1, 30, 20), 2: (1, 300, 30), 3: (1, 500, 10)}


def test_low_deciles_of_30_orders(spark):
    got = {r.decile: (r.sellers, r.orders, r.low) for r in cuts.seller_deciles_low(_sellers(spark)).collect()}
    assert got == {1: (1, 30, 10), 2: (1, 300, 30), 3: (1, 500, 10)}


def test_worst_decile_of_30_orders(spark):
    r = cuts.worst_decile_summary(_sellers(spark)).first()
    assert (r.sellers, round(r.share_of_orders, 6), round(r.share_of_late, 6)) == (1, round(30 / 830, 6), round(20 / 60, 6))


def test_seller_states_of_300_orders(spark):
    items = spark.range(899).select(F.col("id").alias("order_id"), F.when(F.col("id") < 300, 1).when(F.col("id") < 599, 2).otherwise(3).cast("bigint").alias("seller_id"),
                                    F.lit(True).alias("is_delivered"), F.lit("Late").alias("delivery_outcome"), F.lit(True).alias("has_review"), F.lit(False).alias("is_low_score"))
    sellers = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "seller_id bigint, seller_state string")
    got = {r.seller_state: r.orders for r in cuts.by_seller_state(items, sellers).collect()}
    assert got == {"A": 300, "C": 300}
