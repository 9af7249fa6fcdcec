"""Reconciliation tests of the star against the raw layer.

Two sources, neither of which reads a table twice:

* **observed metrics**: sums and counts of conditions of a star table are gathered by
  ``DataFrame.observe`` while the table is written, so a built star answers them without a scan;
* a **census** of keys: every table gives its keys once, as (kind, key, who holds it), and one
  grouping by (kind, key) answers all uniqueness, orphan and coverage tests at once.

Result: one row per test with PASS/FAIL (reported, never asserted: the driver tables have known key
traps, e.g. duplicate (order_id, line number) pairs). A star that isn't written yet is written first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipshape import config as C
from shipshape.functions.exprs import count_if
from shipshape.plans.star import VALIDATED, Star, in_period, materialize
from shipshape.sources.binding import dealt

f = F.col

#: Who holds a key: rows of the raw tables, of the facts, of a dimension.
SIDES = ("raw", "raw_items", "raw_reviews", "fact", "item", "dim")
#: Further sums by key: name -> type.
SUMS = {"price": "decimal(38,2)", "freight": "decimal(38,2)", "shipped": "bigint", "late": "bigint", "other": "bigint"}


def holders(df: DataFrame, side: str, keys: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """(kind, key, sides, sums) of one table in one scan: a row per kind; sums stand with the first kind."""
    given = sums or {}
    first = next(iter(keys))

    def row(kind: str, key: Column) -> Column:
        held = [F.lit(1 if s == side else 0).cast("bigint").alias(s) for s in SIDES]
        more = [F.coalesce(given[n], F.lit(0)).cast(t).alias(n) if n in given and kind == first else F.lit(0).cast(t).alias(n) for n, t in SUMS.items()]
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), *held, *more)
    return df.select(F.explode(F.array(*[row(k, c) for k, c in keys.items()])).alias("r")).select("r.*")


def census(parts: list[DataFrame]) -> DataFrame:
    """One row per (kind, key): how many rows of each side hold it, and its sums."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("kind", "key").agg(*[F.sum(s).alias(s) for s in SIDES], *[F.sum(n).cast(t).alias(n) for n, t in SUMS.items()])


def star_census(s: Star) -> DataFrame:
    m, raw = s.model, s.raw
    n = s.tables.tasks("orders", "lineitem")   # a task's keys before the exchange are nearly all distinct: as many as it reads
    shipped = f("order_status").isin(*C.DELIVERED_STATUSES)
    late = shipped & (F.to_date("order_delivered_customer_date") > F.to_date("order_estimated_delivery_date"))
    person = raw["customers"].select("customer_id", "customer_unique_id")
    orders = raw["orders"].filter(in_period("order_purchase_timestamp")).join(person, "customer_id", "left")
    return census([
        holders(orders, "raw", {"order": f("order_id"), "person": f("customer_unique_id")},
                {"shipped": (shipped & f("order_delivered_customer_date").isNotNull()).cast("int"), "late": late.cast("int"), "other": (~shipped).cast("int")}),
        holders(raw["order_items"], "raw_items", {"order": f("order_id")}, {"price": f("price"), "freight": f("freight_value")}),
        holders(raw["order_reviews_keyed"], "raw_reviews", {"order": f("order_id")}),
        holders(dealt(m["fact_orders"], n), "fact", {"order": f("order_id"), "person": f("customer_unique_id"), "day": f("purchase_date"), "state": f("customer_state")}),
        holders(dealt(m["fact_order_items"], n), "item", {"order": f("order_id"), "line": F.to_json(F.struct("order_id", "order_item_id")), "product": f("product_id"), "seller": f("seller_id")}),
        holders(m["dim_customer"], "dim", {"person": f("customer_unique_id")}),
        holders(m["dim_date"], "dim", {"day": f("date_day")}),
        holders(m["dim_geography"], "dim", {"state": f("state_code")}),
        holders(m["dim_product"], "dim", {"product": f("product_id")}),
        holders(m["dim_seller"], "dim", {"seller": f("seller_id"), "short": f("seller_short")}),
    ])


def metrics(name: str) -> dict[str, Column]:
    """What is observed of a star table while it is written."""
    d, on, outcome = f("is_delivered"), f("is_on_time"), f("delivery_outcome")
    score, reviewed = f("review_score"), f("has_review")
    return {
        "fact_orders": {
            "value": F.sum("items_value"), "freight": F.sum("freight_value"), "items": F.sum("item_count"), "bare": count_if(~f("has_items")),
            "reviewed": count_if(reviewed), "no_score": count_if(reviewed & score.isNull()), "score_only": count_if(~reviewed & score.isNotNull()),
            "off_scale": count_if(~score.between(1, 5)), "delivered": count_if(d), "late": count_if(outcome == "Late"),
            "measured": count_if(outcome.isin("On time", "Late")), "flag_only": count_if(~d & on.isNotNull()), "unlike": count_if(d & (on != (outcome == "On time"))),
            "negative": count_if((f("delivery_days") < 0) | (f("handling_days") < 0) | (f("transit_days") < 0)), "other": count_if(outcome == "Not delivered")},
        "fact_order_items": {"price": F.sum("price")},
        "dim_customer": {"orders": F.sum("order_count")},
        "dim_date": {"first": F.min("date_day"), "last": F.max("date_day")},
        "dim_product": {"bare": count_if(f("category_en").isNull())},
        "dim_seller": {"bare": count_if(f("seller_region").isNull())},
    }.get(name, {})


def _answers(seen: dict[str, dict]) -> list[tuple[Column, Column]]:
    """(expected, actual) of T1-T37 as aggregates of the census and literals of the observed metrics."""
    zero = F.lit(0)

    def of(kind: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(f("kind") == kind, value)), zero)

    def repeated(kind: str, side: str, nulls: bool = False) -> Column:
        """Rows beyond the first of their key; a NULL key counts as no key."""
        return of(kind, f(side)) - of(kind, ((f(side) > 0) if nulls else (f(side) > 0) & f("key").isNotNull()).cast("int"))

    def orphans(kind: str, side: str, within: str) -> Column:
        return of(kind, F.when((f(within) == 0) | f("key").isNull(), f(side)).otherwise(0))

    def seen_of(table: str, name: str) -> Column:
        return F.lit(seen[table][name])
    ours = f("raw") > 0
    fo = {name: seen_of("fact_orders", name) for name in metrics("fact_orders")}
    days = F.datediff(seen_of("dim_date", "last"), seen_of("dim_date", "first")) + 1
    return [
        (of("order", f("raw")), of("order", f("fact"))),
        (of("order", F.when(ours, f("raw_items"))), of("order", f("item"))),
        (of("person", (ours & f("key").isNotNull()).cast("int")), of("person", f("dim"))),
        (of("order", f("fact")), seen_of("dim_customer", "orders")),
        (days, of("day", f("dim"))),
        (zero, repeated("order", "fact")), (zero, repeated("line", "item", True)), (zero, repeated("person", "dim")), (zero, repeated("seller", "dim")),
        (zero, repeated("short", "dim")), (zero, repeated("product", "dim")), (zero, repeated("day", "dim")), (zero, repeated("state", "dim")),
        (zero, orphans("person", "fact", "dim")), (zero, orphans("day", "fact", "dim")), (zero, orphans("state", "fact", "dim")),
        (zero, orphans("order", "item", "fact")), (zero, orphans("product", "item", "dim")), (zero, orphans("seller", "item", "dim")),
        (zero, seen_of("dim_seller", "bare")), (zero, seen_of("dim_product", "bare")),
        (of("order", F.when(ours, f("price"))), seen_of("fact_order_items", "price")), (of("order", F.when(ours, f("price"))), fo["value"]),
        (of("order", F.when(ours, f("freight"))), fo["freight"]), (of("order", f("item")), fo["items"]),
        (of("order", F.when(f("raw_items") == 0, f("raw"))), fo["bare"]),
        (of("order", (ours & (f("raw_reviews") > 0)).cast("int")), fo["reviewed"]),
        (zero, fo["no_score"]), (zero, fo["score_only"]), (zero, fo["off_scale"]),
        (of("order", f("shipped")), fo["delivered"]), (of("order", f("late")), fo["late"]), (fo["delivered"], fo["measured"]),
        (zero, fo["flag_only"]), (zero, fo["unlike"]), (zero, fo["negative"]),
        (of("order", f("other")), fo["other"]),
    ]


def model_validation(s: Star) -> DataFrame:
    """One row per test: test_id, test_group, label, expected, actual, result."""
    if not all(name in s.observed for name in VALIDATED if metrics(name)):
        s = materialize(s, VALIDATED, numbered=False)
    both = _answers(s.observed)
    one = star_census(s).agg(*[c.cast("decimal(18,2)").alias(f"{side}{i}") for i, pair in enumerate(both) for side, c in zip("ea", pair)])
    rows = [F.struct(F.lit(i + 1).cast("bigint").alias("test_id"), F.lit(group).alias("test_group"), F.lit(label).alias("label"),
                     f(f"e{i}").alias("expected"), f(f"a{i}").alias("actual")) for i, (group, label) in enumerate(C.TEST_LABELS)]
    x = one.select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    ok = F.coalesce(f("expected") == f("actual"), F.lit(False))
    return x.withColumn("result", F.when(ok, "PASS").otherwise("FAIL"))
