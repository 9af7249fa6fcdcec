"""Written tables and views: pruned partitions, joins without an exchange, one build a session."""

import pytest

from shipshape.plans import layers as L
from shipshape.plans.star import StarOnce, build_star
from tests.conftest import SF


@pytest.fixture(scope="module")
def once(spark):
    return StarOnce(build_star(spark, SF))


def test_a_quarter_reads_its_months_and_joins_by_bucket(spark, once):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    out = L.quarter_orders(once.layers, 1998, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    facts = [line for line in plan.splitlines() if "FileScan" in line and "fact_order" in line]
    assert len(facts) == 2 and all("dynamicpruning" in line for line in facts)
    rows = out.collect()
    assert {r.purchase_month.month for r in rows} == {4, 5, 6} and {r.purchase_month.year for r in rows} == {1998}
    # facts too large to broadcast: still no exchange on the order, only on the month and outcome
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = L.quarter_orders(once.layers, 1998, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [order_id" in plan and "hashpartitioning(order_id" not in plan
    assert all("Bucketed: true" in line for line in plan.splitlines() if "FileScan" in line and "fact_order" in line)


def test_views_are_asked_by_name(spark, once):
    kinds = {r.tableName: spark.catalog.getTable(f"{once.layers.db}.{r.tableName}").tableType for r in spark.sql(f"SHOW TABLES IN {once.layers.db}").collect()}
    assert kinds["customer_base"] == "VIEW" and kinds["orders_by_month"] == "MANAGED" and kinds["fact_orders"] == "MANAGED"
    assert sum(r.orders for r in L.state_views(once.layers).collect()) == once.model["fact_orders"].count()


def test_star_is_written_once_and_only_when_asked(spark, monkeypatch):
    from shipshape.plans import star as S
    calls = []
    build = S.materialize
    monkeypatch.setattr(S, "materialize", lambda *a, **k: calls.append(1) or build(*a, **k))
    s = StarOnce(build_star(spark, SF))
    s.raw["orders"].count()
    assert not calls
    s.model["dim_customer"], s.stg["orders"], s["fact_orders"], s.observed
    assert len(calls) == 1


def test_a_query_writes_only_the_tables_it_needs(spark):
    import os
    s = StarOnce(build_star(spark, SF))
    assert s.stg["orders"].count() and set(os.listdir(s.written.folder.replace("file:", ""))) == {"stg_orders"}
    s.model["fact_orders"]
    assert set(os.listdir(s.written.folder.replace("file:", ""))) == {"stg_orders", "stg_reviews", "stg_order_items", "fact_orders"}


def test_joins_by_order_are_dealt_by_rows(spark, monkeypatch):
    from shipshape.operators import registered as R
    from shipshape.sources import tables as T
    monkeypatch.setattr(T, "TASK_ROWS", 500)
    star = build_star(spark, SF)
    n = -(-star.tables.lineitem.count() // 500)
    m = -(-max(star.tables.orders.count(), star.tables.events.count()) // 500)
    for df, tasks in ((star.raw["orders"], n), (star.raw["order_items"], n), (star.raw["order_reviews_keyed"], m), (R._cat(star), n), (R._sellers(star), n)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"{tasks}), REPARTITION_BY_NUM" in plan


def test_census_of_keys_is_dealt_by_rows(spark, monkeypatch):
    from shipshape.operators.validate import star_census
    from shipshape.sources import tables as T
    star = build_star(spark, SF)
    rows = star.model["fact_order_items"], star.model["fact_orders"]
    star.model.update(fact_order_items=spark.createDataFrame(rows[0].limit(9).collect(), rows[0].schema), fact_orders=spark.createDataFrame(rows[1].limit(9).collect(), rows[1].schema))
    monkeypatch.setattr(T, "TASK_ROWS", 500)
    n = -(-star.tables.lineitem.count() // 500)
    plan = star_census(star)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    made = [i for i, line in enumerate(lines) if f"{n}), REPARTITION_BY_NUM" in line]
    assert sum(any("ExistingRDD" in x or "LocalTableScan" in x for x in lines[i + 1:i + 4]) for i in made) == 2, plan


def test_ship_dates_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """A scan task doesn't hold a group for nearly each of its rows; null, repeated and unmatched keys."""
    from datetime import datetime

    from shipshape.sources import binding, tables as T
    monkeypatch.setattr(T, "TASK_ROWS", 500)
    star = build_star(spark, SF)
    n = -(-star.tables.lineitem.count() // 500)
    df = star.raw["orders"]
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "l_shipdate" in x)
    dealt = max(i for i, x in enumerate(lines[:scan]) if f"{n}), REPARTITION_BY_NUM" in x)
    assert not any("Aggregate" in x for x in lines[dealt:scan]) and sum("REPARTITION_BY_NUM" in x for x in lines) == 2
    day = [datetime(2020, 1, d) for d in (1, 2, 3)]

    class Own:
        lineitem = spark.createDataFrame([(1, day[1]), (1, day[0]), (1, day[2]), (2, None), (None, day[0]), (1, day[1])], "l_orderkey long, l_shipdate timestamp_ntz")
    assert sorted(map(tuple, binding.ship_window(Own, 3).collect())) == [(1, day[0], day[2]), (2, None, None)]


def _sent_by(plan: str, key: str) -> list[str]:
    """Joins on a key whose one side is sent whole to every task."""
    return [x for x in plan.splitlines() if "BroadcastHashJoin" in x and f"[{key}#" in x]


def test_raw_orders_are_not_sent_to_every_task(spark, monkeypatch):
    """The planner knows bytes of compressed files only: a threshold above them stands for a file that compresses well."""
    from shipshape.sources import tables as T
    monkeypatch.setattr(T, "SENT_ROWS", 500, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        star = build_star(spark, SF)
        for name in ("orders", "order_items", "order_reviews_keyed", "order_reviews"):
            plan = star.raw[name]._jdf.queryExecution().executedPlan().toString()
            assert not _sent_by(plan, "order_id") and "SortMergeJoin [order_id" in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_written_orders_are_not_sent_to_every_task(spark, monkeypatch):
    from shipshape.plans.star import materialize
    from shipshape.sources import tables as T
    monkeypatch.setattr(T, "SENT_ROWS", 500, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        star = materialize(build_star(spark, SF), when_asked=True)
        for name in ("reviews", "order_items", "item_agg", "fact_orders", "fact_order_items", "fact_orders_numbered"):
            plan = star.built(name)._jdf.queryExecution().executedPlan().toString()
            assert not _sent_by(plan, "order_id") and "SortMergeJoin [order_id" in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_written_tables_are_joined_by_order_without_an_exchange(spark):
    """Tables written before are in buckets by order: only raw rows, and the reviews' documents, are dealt again."""
    from shipshape.plans.star import materialize
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = materialize(build_star(spark, SF), when_asked=True)
        for name, of in (("reviews", 2), ("order_items", 1), ("item_agg", 2), ("fact_orders", 4), ("fact_order_items", 3)):
            lines = star.built(name)._jdf.queryExecution().executedPlan().toString().splitlines()
            scans = [x for x in lines if "FileScan" in x and ("stg_" in x or "fact_" in x)]
            assert len(scans) == of and all("Bucketed: true" in x for x in scans), name
            assert not any("Exchange" in x and "ENSURE_REQUIREMENTS" in x and "(order_id" in x for x in lines), name
            assert not any("Exchange hashpartitioning(seller_id" in x for x in lines), name
            if name in ("item_agg", "fact_orders", "fact_order_items"):
                assert not any("Exchange" in x for x in lines), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_sellers_are_not_sent_to_every_task(spark, monkeypatch):
    from shipshape.plans.star import materialize
    from shipshape.sources import tables as T

    def written():
        return materialize(build_star(spark, SF), when_asked=True).stg["order_items"]
    few = written()
    monkeypatch.setattr(T, "SENT_SELLERS", 5, raising=False)
    many = written()
    assert few.count() == many.count() and few.exceptAll(many).count() == 0


def test_shuffle_files_go_when_a_table_is_written(spark):
    import time

    from shipshape.plans.star import materialize

    def shuffled() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in (found.apply(i).getName() for i in range(found.size())) if x.startswith("shuffle_")}
    star = build_star(spark, SF)
    star.tables.rows("supplier")
    before, end = shuffled(), time.time() + 20
    L.write_layers(materialize(star, ("orders", "reviews", "order_items", "fact_orders", "fact_order_items", "dim_customer"), numbered=False))
    while shuffled() - before and time.time() < end:   # files are removed in the background
        time.sleep(0.5)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_the_person_may_be_joined_before_the_ship_dates(spark):
    """Null, repeated and unmatched orders and customers give the same staged orders either way."""
    from datetime import datetime

    from shipshape.plans.star import in_period, stg_orders, with_person
    from shipshape.sources import binding
    day = [datetime(2018, 1, d) for d in (1, 2, 9)] + [datetime(1970, 1, 1)]

    class Own:
        orders = spark.createDataFrame([(1, 7, "F", day[0], "1-URGENT"), (1, 7, "O", day[1], "2-HIGH"), (2, 8, "P", day[2], "5-LOW"), (3, None, "F", day[0], "1-URGENT"),
                                        (None, 7, "F", day[0], "3-MEDIUM"), (4, 9, "F", day[1], None), (5, 7, None, day[3], "1-URGENT"), (6, 99, "F", day[0], "1-URGENT")],
                                       "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string")
        lineitem = spark.createDataFrame([(1, day[1]), (1, day[2]), (2, None), (None, day[0]), (4, day[2]), (6, day[2])], "l_orderkey long, l_shipdate timestamp_ntz")

        def tasks(self, *names):
            return 3

        def rows(self, name):
            return 9
    t = Own()
    people = spark.createDataFrame([(7, 7, "A"), (7, 7, "B"), (8, 8, None), (None, None, "C"), (9, 9, "D")], "customer_id long, customer_unique_id long, customer_state string")
    period = "2018-01-01", "2018-02-01"
    late = stg_orders(binding.raw_orders(t), people, *period)
    placed = with_person(binding.placed_orders(t).filter(in_period("order_purchase_timestamp", *period)), people)
    early = stg_orders(binding.raw_orders(t, placed=placed), None, *period)
    assert late.columns == early.columns and late.count() == 8
    assert sorted(map(str, late.collect())) == sorted(map(str, early.collect()))


def test_layers_take_the_facts_over_by_bucket(spark, once):
    """As many buckets as the star's tables, one file for a bucket of a month."""
    import re
    n, made = once.written.buckets, once.layers
    for name in L.FACTS:
        rows = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {made.db}.{name}").collect()}
        assert int(rows["Num Buckets"]) == n
        files = [f.split(f"{name}/")[1] for f in made.table(name).inputFiles()]
        held = [(f.split("/")[0], re.search(r"_(\d{5})\.c000", f).group(1)) for f in files]
        assert len(held) == len(set(held)) and {int(b) for _, b in held} <= set(range(n))
        assert made.table(name).count() == once.model[name].count()
