"""A measure registry with explicit filter context.

A measure is an aggregate Column over one base table (``orders`` = fact_orders, ``items`` =
fact_order_items, ``customers`` = dim_customer, ``coded`` = coded reviews), or a ratio of two. The
filters of an evaluation are data (``Context``): slicers of the page, filters of the visual, minimum
values of measures. Before anything is planned they are resolved for each part of each measure:

* slicers reach the facts through the dimensions (dim_date, dim_geography), in one direction only:
  customer measures are never filtered by them, and coded reviews are a disconnected table;
* filters that a measure removes don't reach the part that removes them, whether they come from a
  slicer, from the visual or from the axis;
* filters that a measure sets itself replace all others on the same column.

Parts that resolve to the same filters and axis share one aggregation; others are joined to the axis
on the keys that they keep. Item-grain measures count distinct orders in two phases.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from shipshape import config as C
from shipshape.functions.exprs import count_if, one_row, ratio
from shipshape.plans.star import Star

f = F.col


@dataclass(frozen=True)
class Measure:
    name: str
    table: str
    agg: Column | None = None               # plain aggregate over the base table
    num: str | None = None                  # ratio measures: numerator / denominator measure names
    den: str | None = None
    remove: tuple[str, ...] = field(default=())   # keys whose filters are removed for the denominator
    remove_all: bool = False                # CALCULATE(ratio, REMOVEFILTERS): numerator too
    given: tuple[tuple[str, tuple], ...] = ()   # filters the measure sets itself: (column, values)


@dataclass(frozen=True)
class Filter:
    """Rows whose ``column`` is among ``values`` (``keep``), or isn't (NULL is among nothing, so it stays)."""

    column: str
    values: tuple
    keep: bool = True
    scope: str = "visual"                   # "slicer", "visual" or "measure"

    def condition(self) -> Column:
        hit = f(self.column).isin(*self.values)
        return hit if self.keep else ~F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Context:
    """The filters around an evaluation; ``minimum`` keeps axis rows by the value of a measure."""

    filters: tuple[Filter, ...] = ()
    minimum: tuple[tuple[str, float], ...] = ()

    @classmethod
    def of(cls, slicers: dict | None = None, only: dict | None = None, without: dict | None = None, minimum: dict | None = None) -> "Context":
        rows = [Filter(c, tuple(v), True, "slicer") for c, v in (slicers or {}).items()]
        rows += [Filter(c, tuple(v)) for c, v in (only or {}).items()] + [Filter(c, tuple(v), False) for c, v in (without or {}).items()]
        return cls(tuple(rows), tuple((minimum or {}).items()))


@dataclass(frozen=True)
class Scope:
    """Where one part of a measure is computed: the axis columns it keeps and the filters that reach it."""

    keys: tuple[str, ...]
    filters: frozenset[Filter]


def _orders_measures() -> list[Measure]:
    late, on, nd = (f("delivery_outcome") == x for x in ("Late", "On time", "Not delivered"))
    o = "orders"
    return [
        Measure("orders", o, F.count(F.lit(1)).cast("bigint")),
        Measure("gmv", o, F.sum("items_value").cast("double")),
        Measure("orders_with_items", o, count_if(f("has_items"))),
        Measure("average_order_value", o, num="gmv", den="orders_with_items"),
        Measure("freight_share", o, ratio(F.sum("freight_value"), F.sum("order_total"))),
        Measure("delivered_orders", o, count_if(f("is_delivered"))),
        Measure("on_time_orders", o, count_if(on)),
        Measure("late_orders", o, count_if(late)),
        Measure("not_delivered_orders", o, count_if(nd)),
        Measure("on_time_rate", o, num="on_time_orders", den="delivered_orders"),
        Measure("late_rate", o, num="late_orders", den="delivered_orders"),
        Measure("not_delivered_rate", o, num="not_delivered_orders", den="orders"),
        Measure("avg_delay_late", o, F.avg(F.when(late, f("delay_days")).cast("double"))),
        Measure("median_delay_late", o, F.median(F.when(late, f("delay_days")).cast("double"))),
        Measure("median_delivery_days", o, F.median(f("delivery_days").cast("double"))),
        Measure("late_handed_over_late", o, count_if(late & f("is_seller_handover_late"))),
        Measure("late_handed_over_late_share", o, num="late_handed_over_late", den="late_orders"),
        Measure("late_rate_all_states", o, num="late_orders", den="delivered_orders",
                remove=("state_name", "customer_state", "region"), remove_all=True),
        Measure("reviewed_orders", o, count_if(f("has_review"))),
        Measure("avg_review_score", o, F.avg(f("review_score").cast("double"))),
        Measure("low_score_orders", o, count_if(f("is_low_score"))),
        Measure("low_score_share", o, num="low_score_orders", den="reviewed_orders"),
        Measure("commented_orders", o, count_if(f("has_comment"))),
        Measure("comment_share", o, num="commented_orders", den="reviewed_orders"),
        Measure("share_of_orders", o, num="orders", den="orders", remove=("delivery_outcome", "delivery_outcome_sort")),
        Measure("share_of_low_score_reviews", o, num="low_score_orders", den="low_score_orders",
                remove=("delivery_outcome", "delivery_outcome_sort")),
        Measure("low_score_share_single_item", o, num="low_score_orders", den="reviewed_orders", given=(("order_size", ("Single item",)),)),
        Measure("low_score_share_several_items", o, num="low_score_orders", den="reviewed_orders", given=(("order_size", ("Several items",)),)),
        Measure("problem_orders", o, count_if(late | nd)),
        Measure("problem_order_share", o, num="problem_orders", den="orders"),
        Measure("problem_low", o, count_if((late | nd) & f("is_low_score"))),
        Measure("problem_low_share", o, num="problem_low", den="low_score_orders"),
    ]


def _item_measures() -> list[Measure]:
    i = "items"
    return [
        Measure("item_gmv", i, F.sum("_gmv").cast("double")),
        Measure("item_orders", i, F.count(F.lit(1)).cast("bigint")),
        Measure("item_delivered_orders", i, F.sum("_delivered").cast("bigint")),
        Measure("item_late_orders", i, F.sum("_late").cast("bigint")),
        Measure("item_late_rate", i, num="item_late_orders", den="item_delivered_orders"),
        Measure("item_reviewed_orders", i, F.sum("_reviewed").cast("bigint")),
        Measure("item_low_score_orders", i, F.sum("_low").cast("bigint")),
        Measure("item_low_score_share", i, num="item_low_score_orders", den="item_reviewed_orders"),
        Measure("item_avg_review_score", i, F.avg(f("_score").cast("double"))),
        Measure("low_score_share_all_categories", i, num="item_low_score_orders", den="item_reviewed_orders",
                remove=("category_en", "category_pt", "product_id"), remove_all=True),
    ]


def _other_measures() -> list[Measure]:
    rep = count_if(f("is_repeat_customer"))
    return [
        Measure("customers", "customers", F.count(F.lit(1)).cast("bigint")),
        Measure("repeat_customers", "customers", rep),
        Measure("repeat_purchase_rate", "customers", num="repeat_customers", den="customers"),
        Measure("coded_reviews", "coded", F.count(F.lit(1)).cast("bigint")),
        Measure("complaint_share", "coded", num="coded_reviews", den="coded_reviews", remove=("primary_category",)),
    ]


class _Registry(dict):
    """name -> Measure; built on first use (Columns need an active session)."""

    def _fill(self):
        if not dict.__len__(self):
            self.update({m.name: m for m in _orders_measures() + _item_measures() + _other_measures()})

    def __getitem__(self, k):
        self._fill()
        return dict.__getitem__(self, k)

    def __iter__(self):
        self._fill()
        return dict.__iter__(self)

    def __len__(self):
        self._fill()
        return dict.__len__(self)


REGISTRY: dict[str, Measure] = _Registry()

# columns reachable from each base through its dimensions
_ORDER_DIMS = {"year": "date", "year_month": "date", "month_name": "date", "state_name": "geo", "region": "geo"}
_ITEM_DIMS = dict(_ORDER_DIMS, category_en="product", category_pt="product", seller_short="seller",
                  seller_state="seller", seller_region="seller")


def _base(star: Star, table: str, cols: set[str], coded: DataFrame | None) -> DataFrame:
    m = star.model
    if table == "customers":
        return m["dim_customer"]
    if table == "coded":
        return coded
    fact = m["fact_orders"] if table == "orders" else m["fact_order_items"]
    dims = _ORDER_DIMS if table == "orders" else _ITEM_DIMS
    need = {dims[c] for c in cols if c in dims}
    if "date" in need:
        fact = fact.join((m["dim_date"].select(f("date_day").alias("purchase_date"), "year", "year_month",
                                                          "month_name")), "purchase_date", "inner")
    if "geo" in need:
        fact = fact.join((m["dim_geography"].select(f("state_code").alias("customer_state"), "state_name",
                                                               "region")), "customer_state", "inner")
    if "product" in need:
        fact = fact.join(m["dim_product"], "product_id", "inner")
    if "seller" in need:
        fact = fact.join(m["dim_seller"].select("seller_id", "seller_short", "seller_state", "seller_region"),
                         "seller_id", "inner")
    return fact


def _aggregate(base: DataFrame, table: str, keys, leaves, suffix: str = "") -> DataFrame:
    if table == "items":                    # distinct orders: (keys, order) first, flags constant per order
        base = base.groupBy(*keys, "order_id").agg(
            F.sum("price").alias("_gmv"), F.max(f("is_delivered").cast("int")).alias("_delivered"),
            F.max((f("delivery_outcome") == "Late").cast("int")).alias("_late"),
            F.max(f("has_review").cast("int")).alias("_reviewed"),
            F.max(F.coalesce(f("is_low_score"), F.lit(False)).cast("int")).alias("_low"),
            F.max("review_score").alias("_score"))
    aggs = [REGISTRY[n].agg.alias(n + suffix) for n in leaves]
    return base.groupBy(*keys).agg(*aggs) if keys else base.agg(*aggs)


def resolve(m: Measure, by: tuple[str, ...], context: Context) -> dict[str, tuple[str, Scope]]:
    """The parts of a measure (value, or num and den) with their leaf measure and scope."""
    reaching = [x for x in context.filters if x.scope != "slicer" or m.table in ("orders", "items")]

    def scope(removed: tuple[str, ...] = ()) -> Scope:
        gone = set(removed) | {c for c, _ in m.given}
        own = [Filter(c, tuple(v), True, "measure") for c, v in m.given]
        return Scope(tuple(k for k in by if k not in gone), frozenset([x for x in reaching if x.column not in gone] + own))
    if m.agg is not None:
        return {"value": (m.name, scope())}
    return {"num": (m.num, scope(m.remove if m.remove_all else ())), "den": (m.den, scope(m.remove))}


def evaluate(star: Star, measures: list[str], by: list[str] | None = None, context: Context = Context(),
             coded: DataFrame | None = None) -> DataFrame:
    """Evaluate measures of one base table on the axis ``by`` under ``context``.

    The axis has the rows that the filters of the context leave; a measure may look beyond them.
    """
    by = tuple(by or ())
    names = list(dict.fromkeys([*measures, *(n for n, _ in context.minimum)]))
    tables = {REGISTRY[n].table for n in names}
    assert len(tables) == 1, "one base table per evaluation"
    table = tables.pop()
    parts = {n: resolve(REGISTRY[n], by, context) for n in names}
    axis = resolve(Measure("", table, F.lit(1)), by, context)["value"][1]
    wanted: dict[Scope, list[str]] = {axis: []}
    for leaf, scope in (p for ps in parts.values() for p in ps.values()):
        leaves = wanted.setdefault(scope, [])
        if leaf not in leaves:
            leaves.append(leaf)
    if not wanted[axis]:
        wanted[axis].append({"orders": "orders", "items": "item_orders", "customers": "customers", "coded": "coded_reviews"}[table])
    columns = set(by) | {x.column for scope in wanted for x in scope.filters}
    base = _base(star, table, columns, coded)
    out, number = None, {}
    for i, (scope, leaves) in enumerate(wanted.items()):
        number[scope] = i
        rows = base
        for x in sorted(scope.filters, key=repr):
            rows = rows.filter(x.condition())
        found = _aggregate(rows, table, scope.keys, leaves, f"__{i}")
        if out is None:
            out = found
        elif scope.keys:
            found = found.select(*[f(k).alias(f"__{i}_{k}") for k in scope.keys], *[f"{n}__{i}" for n in leaves])
            on = [f(k).eqNullSafe(f(f"__{i}_{k}")) for k in scope.keys]
            out = out.join(found, on, "left").drop(*[f"__{i}_{k}" for k in scope.keys])
        else:
            one = one_row(found)
            out = out.select("*", *[one[f"{n}__{i}"].alias(f"{n}__{i}") for n in leaves])

    def at(part: tuple[str, Scope]) -> Column:
        return f(f"{part[0]}__{number[part[1]]}")
    cols = {n: at(ps["value"]) if "value" in ps else ratio(at(ps["num"]), at(ps["den"])) for n, ps in parts.items()}
    for n, least in context.minimum:
        out = out.filter(cols[n] >= least)
    return out.select(*by, *[cols[n].alias(n) for n in measures])


# --- visuals --------------------------------------------------------------------------------------

CARD_ORDER_MEASURES = ["orders", "delivered_orders", "on_time_orders", "late_orders", "not_delivered_orders",
                       "on_time_rate", "late_rate", "not_delivered_rate", "gmv", "orders_with_items",
                       "average_order_value", "freight_share", "avg_delay_late", "median_delay_late",
                       "median_delivery_days", "reviewed_orders", "avg_review_score", "low_score_orders",
                       "low_score_share", "comment_share", "late_handed_over_late_share",
                       "problem_order_share", "problem_low_share"]   # the last two: page headline (M27)


def measures_total(star: Star) -> DataFrame:
    """V1: the card values, no filter (order measures + customer measures)."""
    o = evaluate(star, CARD_ORDER_MEASURES)
    c = evaluate(star, ["customers", "repeat_customers", "repeat_purchase_rate"])
    r = one_row(c)
    return o.select("*", *[r[n].alias(n) for n in c.columns])


def measures_by_month(star: Star, slicers: dict | None = None) -> DataFrame:
    """V2: trend by month."""
    return evaluate(star, ["orders", "late_rate", "low_score_share", "avg_review_score"], ["year_month"], Context.of(slicers))


def share_pair_by_outcome(star: Star, reference: str = "On time") -> DataFrame:
    """V3 (M22, M23): shares over all outcomes (filter on the outcome removed); M26: the bar colour
    rule as a boolean (the bar of the reference outcome vs the others)."""
    x = evaluate(star, ["orders", "share_of_orders", "low_score_orders", "share_of_low_score_reviews"],
                 ["delivery_outcome", "delivery_outcome_sort"])
    return x.withColumn("is_reference_outcome", f("delivery_outcome") == reference)


def state_late_flag(star: Star, min_orders: int = C.MIN_STATE_ORDERS) -> DataFrame:
    """V4 (M17, M18): late rate by state with enough orders vs the rate over all states."""
    x = evaluate(star, ["orders", "late_orders", "late_rate", "low_score_share", "late_rate_all_states"], ["state_name"], Context.of(minimum={"orders": min_orders}))
    return x.withColumn("is_above_national", f("late_rate") > f("late_rate_all_states"))


def band_visuals(star: Star) -> DataFrame:
    """V5: orders by days late (bands of late orders only), and low share by band (all but unknown)."""
    axis, shown = ["delay_band", "delay_band_sort"], []
    for name, hidden in (("late_by_band", [b for b in C.DELAY_BANDS if b not in C.LATE_BANDS]), ("low_by_band", [C.DELAY_BANDS[-1]])):
        x = evaluate(star, ["orders", "late_orders", "low_score_share", "avg_review_score"], axis, Context.of(without={"delay_band": hidden}))
        shown.append(x.select(F.lit(name).alias("visual"), "*"))
    return shown[0].unionByName(shown[1])


def seller_ranking(star: Star, min_orders: int = C.MIN_SELLER_ORDERS, top: int = C.TOP_SELLERS) -> DataFrame:
    """V6: sellers with enough orders ranked by late orders (top list), with the number of such sellers."""
    x = evaluate(star, ["item_orders", "item_late_orders", "item_late_rate", "item_low_score_share"],
                 ["seller_short", "seller_state"], Context.of(minimum={"item_orders": min_orders}))
    n = x.agg(F.count(F.lit(1))).scalar()
    return (x.orderBy(f("item_late_orders").desc(), f("item_orders").desc(), f("seller_short")).limit(top)
            .withColumn("sellers_min", n.cast("bigint")))


def size_by_outcome(star: Star) -> DataFrame:
    """V7 (M24, M25): low share of single and of several items by outcome (unknown hidden by the visual)."""
    return evaluate(star, ["orders", "low_score_orders", "low_score_share", "low_score_share_single_item", "low_score_share_several_items"],
                    ["delivery_outcome", "delivery_outcome_sort"], Context.of(without={"delivery_outcome": [C.OUTCOMES[3]]}))


def size_shares_by_region(star: Star, region: str = C.SLICER_REGION) -> DataFrame:
    """M23-M25 under a slicer, on an axis that two of them override: by outcome and order size, the shares of
    single and of several items stay those of the outcome, the share of low reviews is of all outcomes of the size."""
    return evaluate(star, ["orders", "low_score_share", "share_of_low_score_reviews", "low_score_share_single_item", "low_score_share_several_items"],
                    ["delivery_outcome", "order_size"], Context.of(slicers={"region": [region]}, without={"delivery_outcome": [C.OUTCOMES[3]]}))


def complaint_matrix(star: Star, coded: DataFrame) -> DataFrame:
    """V8 (M41, M42): coded reviews by category x group with the complaint share inside the group."""
    by_group = evaluate(star, ["coded_reviews", "complaint_share"], ["primary_category", "delivery_group"], coded=coded)
    overall = evaluate(star, ["coded_reviews", "complaint_share"], ["primary_category"], coded=coded)
    overall = overall.select("primary_category", f("coded_reviews").alias("category_reviews"),
                             f("complaint_share").alias("category_share"))
    return by_group.join(overall, "primary_category", "inner")


def category_matrix(star: Star, min_orders: int = C.MIN_CATEGORY_ORDERS, top: int = C.TOP_MATRIX_CATEGORIES) -> DataFrame:
    """V9 (M31-M40): categories with enough orders, top by item GMV, with the all-categories low share."""
    x = evaluate(star, ["item_gmv", "item_orders", "item_low_score_share", "item_avg_review_score",
                        "low_score_share_all_categories"], ["category_en"], Context.of(minimum={"item_orders": min_orders}))
    return x.orderBy(f("item_gmv").desc(), f("category_en")).limit(top)


def measures_sliced(star: Star, year: int = C.SLICER_YEAR, region: str = C.SLICER_REGION) -> DataFrame:
    """Year + region slicers: order measures by month are filtered, customer measures are not."""
    x = measures_by_month(star, {"year": [year], "region": [region]})
    c = evaluate(star, ["customers", "repeat_purchase_rate"], context=Context.of({"year": [year]}))
    r = one_row(c)
    return x.select("*", *[r[n].alias(n) for n in c.columns])
