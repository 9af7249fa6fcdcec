"""Check suites: what they scan, observed metrics, NULL keys, and the helpers against small tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shipshape.functions.exprs import null_splitting_left_join
from shipshape.operators import profile, quality, validate
from shipshape.plans.star import VALIDATED, materialize


def scans(df) -> Counter:
    """Scans of each Parquet folder in the physical plan."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"FileScan parquet .*?Location: \w+\(\d+ paths\)\[.*?/([\w.-]+?)(?:\.parquet)?(?:/part[^\]]*)?\]", plan))


@pytest.fixture(scope="module")
def built(star):
    return materialize(star, VALIDATED, numbered=False)


def test_validation_of_a_built_star_reads_every_table_once(built):
    seen = scans(validate.model_validation(built))
    star_tables = [t for t in VALIDATED if t.startswith(("fact", "dim"))]
    assert {t: seen[t] for t in star_tables} == dict.fromkeys(star_tables, 1), seen
    # raw orders, items and reviews once each; all three read the orders table
    assert seen["lineitem"] <= 2 and seen["events"] == 1 and seen["customer"] == 1 and seen["orders"] <= 3


def test_observed_metrics_equal_aggregates(built):
    for name in VALIDATED:
        wanted = validate.metrics(name)
        if wanted:
            assert built.observed[name] == built[name].agg(*[c.alias(n) for n, c in wanted.items()]).first().asDict(), name


def test_validation_finds_what_is_broken(built):
    """A repeated order, an item of no order and a person of no dimension row turn their tests."""
    from dataclasses import replace

    def results(s):
        return {r["test_id"]: (r["expected"], r["actual"]) for r in validate.model_validation(s).collect()}
    before = results(built)
    model = built.model.copy()
    facts, items = model["fact_orders"], model["fact_order_items"]
    some = items.limit(1)
    model["fact_orders"] = facts.union(facts.limit(2))
    model["fact_order_items"] = items.union(some.withColumn("order_id", F.lit(-5).cast("bigint"))).union(some.withColumn("order_id", F.lit(None).cast("bigint")))
    model["dim_customer"] = model["dim_customer"].where(F.col("customer_unique_id") != facts.first()["customer_unique_id"])
    model["dim_geography"] = model["dim_geography"].union(model["dim_geography"])
    after = results(replace(built, model=model))
    gone = facts.where(F.col("customer_unique_id") == facts.first()["customer_unique_id"]).count()
    states = model["dim_geography"].count() // 2
    assert [int(after[t][1] - before[t][1]) for t in (1, 2, 6, 7, 13, 17)] == [2, 2, 2, 0, states, 2]
    assert int(after[14][1]) in (gone, gone + 1, gone + 2) and int(before[14][1]) == 0


def test_lists_scan_each_relation_once_a_key(star):
    assert scans(quality.duplicate_reviews(star))["events"] == 1
    # reviews with and without a comment are two scans of disjoint rows
    assert scans(quality.shared_review_ids(star))["events"] == 2
    assert scans(quality.comment_checks(star))["events"] == 2
    assert scans(quality.entity_checks(star))["customer"] == 1
    seen = scans(profile.trap_checks(star))
    assert seen["events"] == 3 and seen["customer"] == 2 and seen["part"] <= 2, seen


def test_null_keys_go_round_the_exchange(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, 6), (4, None)], "id int, k int")
    right = spark.createDataFrame([(5, "x"), (None, "never"), (5, "y")], "k int, v string")
    out = null_splitting_left_join(left, right, "k")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, left.join(right, "k", "left").select("id", "k", "v").collect()), key=str)
    assert out.columns == ["id", "k", "v"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = null_splitting_left_join(left, right, "k")._jdf.queryExecution().executedPlan().toString()
        joined, bare = plan.split("Filter isnull(k")  # the last branch of the union
        assert joined.count("Exchange hashpartitioning(k") == 2 and "Filter isnotnull(k" in joined and "Exchange" not in bare and "Join" not in bare
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hot = spark.range(20_000).select("id", F.lit(None).cast("int").alias("k"))
    assert null_splitting_left_join(hot, right, "k").agg(F.count("id"), F.count("v")).first() == (20_000, 0)


def test_box_and_missing_predicates(spark):
    df = spark.createDataFrame([(1, 1, None), (9, 1, 2), (1, 9, None), (None, None, None)], "a int, b int, c int")
    assert df.where(profile.outside_box({"a": (0, 5), "b": (0, 5)})).count() == 2
    assert df.where(profile.all_missing(["a", "c"])).count() == 1
