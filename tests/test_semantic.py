"""Filter contexts: resolved before planning, and the results they give on small data."""

import pytest
from pyspark.sql import functions as F

from shipshape import catalog
from shipshape.operators import semantic as S
from shipshape.plans.star import StarOnce, build_star
from tests.conftest import SF


@pytest.fixture(scope="module")
def once(spark):
    return StarOnce(build_star(spark, SF))


def test_filters_are_resolved_for_each_part(spark):
    context = S.Context.of(slicers={"region": ["ASIA"]}, without={"delivery_outcome": ["Unknown"]}, only={"order_size": ["Single item"]})
    sliced, hidden, only = (S.Filter("region", ("ASIA",), True, "slicer"), S.Filter("delivery_outcome", ("Unknown",), False), S.Filter("order_size", ("Single item",)))
    by = ("delivery_outcome", "order_size")
    assert S.resolve(S.REGISTRY["orders"], by, context) == {"value": ("orders", S.Scope(by, frozenset([sliced, hidden, only])))}
    share = S.resolve(S.REGISTRY["share_of_orders"], by, context)
    assert share["num"][1] == S.Scope(by, frozenset([sliced, hidden, only]))
    assert share["den"][1] == S.Scope(("order_size",), frozenset([sliced, only]))  # the outcome's filters are removed, wherever they come from
    several = S.resolve(S.REGISTRY["low_score_share_several_items"], by, context)
    own = S.Filter("order_size", ("Several items",), True, "measure")
    assert several["num"][1] == several["den"][1] == S.Scope(("delivery_outcome",), frozenset([sliced, hidden, own]))  # replaces visual filter and axis
    assert S.resolve(S.REGISTRY["customers"], (), context)["value"][1].filters == frozenset([hidden, only])  # slicers don't reach the people


def test_every_measure_is_evaluated(once):
    """Each registered measure alone, without axis: one row, one column."""
    coded = None
    for name in S.REGISTRY:
        if S.REGISTRY[name].table == "coded":
            from shipshape.operators import coding
            coded = coding.coded_reviews(once.model["_frame"], once.tables.documents)
        row = S.evaluate(once, [name], coded=coded).collect()
        assert len(row) == 1 and row[0].asDict().keys() == {name}, name


def test_minimum_keeps_rows_by_a_measure_that_is_not_shown(once):
    every = S.evaluate(once, ["late_orders", "orders"], ["state_name"]).collect()
    bound = sorted(r.orders for r in every)[len(every) // 2]
    kept = S.evaluate(once, ["late_orders"], ["state_name"], S.Context.of(minimum={"orders": bound}))
    assert kept.columns == ["state_name", "late_orders"]
    assert {r.state_name for r in kept.collect()} == {r.state_name for r in every if r.orders >= bound}
    assert 0 < kept.count() < len(every)


def test_axis_with_null_keys_keeps_its_rows(once):
    from dataclasses import replace
    model = once.model.copy()
    model["fact_orders"] = model["fact_orders"].withColumn("order_size", F.when(F.col("order_size") != "No items", F.col("order_size")))
    out = S.evaluate(replace(once.written, model=model), ["orders", "share_of_orders"], ["delivery_outcome", "order_size"]).collect()
    by_size = {}
    for r in out:
        by_size[r.order_size] = by_size.get(r.order_size, 0) + r.share_of_orders
    assert None in by_size and all(abs(v - 1) < 1e-9 for v in by_size.values())


@pytest.mark.parametrize("name", ["category_shares_ci", "sample_allocation", "sample_key", "tag_counts", "coding_violations", "complaint_matrix"])
def test_statistics_of_reviews_read_no_text(once, name):
    out = catalog.QUERIES[name](once)
    once.spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("text" in line for line in plan.splitlines() if "ReadSchema" in line or "Exchange" in line)


def test_texts_of_a_sample_are_not_shuffled(once):
    plan = catalog.QUERIES["stratified_sample"](once)._jdf.queryExecution().executedPlan().toString()
    assert "review_comment_message" in plan and "BroadcastExchange" in plan
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(comment_doc_id" in line]
    assert not shuffled
