"""Invariants of the model."""

from pyspark.sql import functions as F

from shipshape.operators import kpis
from shipshape.plans.star import numbered_facts


def test_on_time_plus_late_is_delivered(star):
    k = kpis.kpi_orders(star.model["fact_orders"], star.model["dim_date"]).collect()
    for r in k:
        assert r.on_time_orders + r.late_orders == r.delivered_orders
    total = [r for r in k if r.period == "Total"][0]
    assert sum(r.orders for r in k if r.period != "Total") == total.orders


def test_one_row_per_order_and_item_grain(star):
    fo = star.model["fact_orders"]
    assert fo.count() == fo.select("order_id").distinct().count()
    assert star.model["fact_order_items"].count() == star.stg["order_items"].count()


def test_customer_order_number_is_dense(star):
    fo = numbered_facts(star)
    g = fo.groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("n"), F.max("customer_order_number").alias("m"),
                                             F.min("customer_order_number").alias("lo"))
    assert g.filter((F.col("n") != F.col("m")) | (F.col("lo") != 1)).count() == 0


def test_sample_disjoint_from_pilot_and_sized(star, spark):
    from shipshape.operators.registered import _drawn
    sample, pilot = _drawn(star)
    assert sample.count() == 60
    assert sample.join(pilot, "review_id").count() == 0


def test_results_do_not_depend_on_the_session_time_zone(star, spark):
    from shipshape import catalog
    names = ("stg_orders", "dim_date", "survey_timing", "stg_reviews_latest")
    def snap():
        return {n: sorted(map(tuple, catalog.round_doubles(catalog.QUERIES[n](star)).collect()), key=str) for n in names}
    utc = snap()
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        assert snap() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_lazy_layer_builds_on_first_access_only():
    import pytest

    from shipshape.plans.star import LazyLayer
    calls = []
    layer = LazyLayer({"a": lambda m: calls.append("a") or 1, "b": lambda m: m["a"] + 1})
    assert "a" in layer and "b" in layer and "c" not in layer and calls == []
    assert layer["b"] == 2 and layer["a"] == 1 and calls == ["a"]      # each builder runs once
    copy = layer.copy()
    copy["a"] = 10
    assert copy["a"] == 10 and layer["a"] == 1 and "b" in copy
    with pytest.raises(KeyError):
        layer["c"]


def test_kpi_cube_of_an_empty_period_is_one_total_row(spark, star):
    from shipshape.operators.kpis import kpi_orders

    out = kpi_orders(star.model["fact_orders"].limit(0), star.model["dim_date"]).collect()
    assert [(r["period"], r["orders"], r["late_orders"], r["gmv"], r["late_rate"]) for r in out] == [("Total", 0, 0, None, None)]
