"""Plan shapes that matter at scale: checked on the physical plan, not on data."""

from shipshape import catalog
from shipshape.operators import quality


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_order_measures_have_no_expand(star):
    # count(DISTINCT order) FILTER (...) is rewritten as two-phase aggregation: no row-multiplying Expand
    for name in ("category_stats", "seller_stats", "by_seller_state", "order_composition"):
        assert "Expand" not in _plan(catalog.QUERIES[name](star)), name


def test_latest_review_is_a_partial_aggregation(star):
    p = _plan(star.stg["reviews"])
    assert "Window" not in p and "max_by" in p


def test_money_quantiles_avoid_single_task_percentile(star):
    from pyspark.sql import functions as F

    from shipshape.operators.rank import running_total
    p = _plan(quality.price_quantiles(star))
    assert "percentile(" not in p
    from tests.test_checks import scans
    assert scans(quality.price_quantiles(star))["lineitem"] <= 2
    counts = star.raw["order_items"].groupBy("price").agg(F.count(F.lit(1)).alias("n"))
    p = _plan(running_total(counts, ["price"], "n", partitions=4))
    assert "rangepartitioning" not in p and "hashpartitioning(_rk_bucket" in p  # windows by bucket


def test_period_filter_and_columns_reach_the_scan(star):
    p = _plan(star.stg["orders"])
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    li = [line for line in _plan(catalog.QUERIES["kpi_orders"](star)).splitlines() if "lineitem.parquet" in line]
    assert li and all("l_comment" not in line and "l_quantity" not in line for line in li)


def test_profile_has_no_expand_and_shuffles_no_text(star):
    from shipshape.operators import profile
    from shipshape.sources import binding
    exact_plan = profile.column_profile(star.raw["orders"], "orders", ("order_id",))
    approx = profile.column_profile(star.raw["orders"], "orders", ("order_id",), exact=False)
    assert "Expand" not in _plan(exact_plan) and "Expand" not in _plan(approx)
    counts = _plan(profile.distinct_counts(binding.comment_texts(star.tables)))
    assert all("text" not in line for line in counts.splitlines() if "Exchange" in line) and "Exchange" in counts
    exact = {r.column_name: r.distinct_values for r in exact_plan.collect()}
    est = {r.column_name: r.distinct_values for r in approx.collect()}
    assert all(abs(est[k] - v) <= max(2, 0.05 * v) for k, v in exact.items())


def test_sketches_merge_like_one_pass(spark, tmp_path):
    from pyspark.sql import functions as F

    from shipshape.operators import sketches
    df = spark.range(0, 30000).select((F.col("id") % 7000).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("b"), (F.col("id") % 3).cast("string").alias("m"))
    store = sketches.SketchStore(spark, str(tmp_path))
    assert store.read() is None
    for part in range(3):
        store.refresh(sketches.sketched(df.where(F.col("a") % 3 == part), F.col("m"), ["a", "b"]))
    got = {(r.column_name, r.month): r.estimate for r in sketches.estimates(store.read()).collect()}
    once = {(r.column_name, r.month): r.estimate for r in sketches.estimates(sketches.sketched(df, F.col("m"), ["a", "b"])).collect()}
    exact = {(c, str(m)): df.where(F.col("m") == str(m)).select(c).distinct().where(F.col(c).isNotNull()).count() for c in "ab" for m in range(3)}
    assert got.keys() == once.keys() == exact.keys()
    assert all(abs(v - exact[k]) <= max(1, sketches.ERROR * exact[k]) and abs(v - once[k]) <= max(1, sketches.ERROR * exact[k]) for k, v in got.items())
    assert store.read().agg(F.sum("rows")).first()[0] == df.agg(F.count("a") + F.count("b")).first()[0]
