"""Cuts of the facts by delivery, composition, category, seller, geography, price, cohort.

Distinct-order measures on the item grain are two-phase: group by (key, order_id) taking the
order-level flags (constant per order), then group by key and sum — no Expand, partial
aggregation in both phases. Denominators outside the group are scalar subqueries (evaluated once).
Deciles use the range-partitioned exact ntile of :mod:`shipshape.operators.rank`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipshape import config as C
from shipshape.functions.exprs import count_if, ratio, wilson
from shipshape.operators.kpis import order_measures
from shipshape.operators.quantiles import quantiles
from shipshape.operators.rank import desc, ntile
from shipshape.sources.binding import dealt

f = F.col


def _scalar(df: DataFrame, agg: Column) -> Column:
    return df.agg(agg).scalar()


def _pack(x: DataFrame, group: list, extra: list | None = None) -> DataFrame:
    return x.groupBy(*group).agg(*order_measures(), *(extra or []))


# --- A: delivery --------------------------------------------------------------------------------

def by_outcome(fact: DataFrame) -> DataFrame:
    """H1: pack by outcome + share of all orders and of all low reviews (all outcomes)."""
    total = _scalar(fact, F.count(F.lit(1)))
    total_low = _scalar(fact, count_if(f("is_low_score")))
    return _pack(fact, ["delivery_outcome"], [count_if(f("is_low_score")).alias("_low")]).select(
        "delivery_outcome", "orders", "late_rate", "reviewed", "avg_score", "low_reviews", "low_share",
        ratio(f("orders"), total).alias("share_of_orders"), ratio(f("_low"), total_low).alias("share_of_low_reviews"))


def by_delay_band(fact: DataFrame) -> DataFrame:
    """H2: pack by delay band (with its sort key)."""
    return _pack(fact, ["delay_band", "delay_band_sort"])


def not_delivered_by_status(fact: DataFrame) -> DataFrame:
    """H3: not-delivered orders by status."""
    return _pack(fact.filter(f("delivery_outcome") == "Not delivered"), ["order_status"])


def late_review_timing(fact: DataFrame) -> DataFrame:
    """H4: late reviewed orders, review answered before vs after the delivery."""
    before, after = C.REVIEW_TIMING
    label = F.when(f("review_before_delivery"), F.lit(before)).otherwise(F.lit(after)).alias("review_timing")
    return _pack(fact.filter((f("delivery_outcome") == "Late") & f("has_review")), [label])


def delivery_band(days: Column) -> Column:
    expr = None
    for _, hi, label in C.DELIVERY_BANDS:
        expr = F.when(days <= hi, label) if expr is None else expr.when(days <= hi, label)
    return expr.otherwise(C.DELIVERY_BAND_OTHER)


def on_time_by_speed(fact: DataFrame) -> DataFrame:
    """H5: on-time orders by delivery time, all vs single-item, in one pass (J15 without zip)."""
    x = fact.filter(f("delivery_outcome") == "On time")
    one = f("item_count") == 1
    return x.groupBy(delivery_band(f("delivery_days")).alias("delivery_band")).agg(
        F.min("delivery_days").alias("min_days"), F.count(F.lit(1)).cast("bigint").alias("orders"),
        ratio(count_if(f("is_low_score")), count_if(f("has_review"))).alias("low_share"),
        count_if(one).alias("orders_single"),
        ratio(count_if(one & f("is_low_score")), count_if(one & f("has_review"))).alias("low_share_single"))


def time_decomposition(fact: DataFrame) -> DataFrame:
    """H6: medians of promised/delivery/handling/transit days and late handovers (of known handovers)."""
    x = fact.filter(f("is_delivered"))
    late_ho = count_if(f("is_seller_handover_late"))
    return x.groupBy("delivery_outcome").agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"),
        *[F.median(f(c).cast("double")).alias(f"median_{c}") for c in
          ("promised_days", "delivery_days", "handling_days", "transit_days")],
        late_ho.alias("handover_late"), ratio(late_ho, F.count("is_seller_handover_late")).alias("handover_late_share"))


def monthly_rates_corr(kpi: DataFrame) -> DataFrame:
    """H7: monthly late and low shares with their correlation over months (small result)."""
    m = kpi.filter(f("period") != "Total")
    corr = _scalar(m, F.corr("late_rate", "low_score_rate"))
    return m.select("period", "orders", "late_rate", "not_delivered_rate", "low_score_rate", "avg_review_score",
                    corr.alias("month_corr"))


def _gap_cols(prefix: str = "") -> list[Column]:
    ot, lt = f("delivery_outcome") == "On time", f("delivery_outcome") == "Late"
    return [count_if(ot & f("has_review")).alias("on_time_n"),
            ratio(count_if(ot & f("is_low_score")), count_if(ot & f("has_review"))).alias("on_time_low"),
            count_if(lt & f("has_review")).alias("late_n"),
            ratio(count_if(lt & f("is_low_score")), count_if(lt & f("has_review"))).alias("late_low")]


def _with_region(fact: DataFrame, geo: DataFrame) -> DataFrame:
    g = geo.select(f("state_code").alias("customer_state"), "region", "state_name")
    return fact.join(g, "customer_state", "inner")


def gap_region_range(fact: DataFrame, geo: DataFrame) -> DataFrame:
    """Late-minus-on-time low share per region -> min and max over regions."""
    g = _with_region(fact, geo).groupBy("region").agg(*_gap_cols())
    g = g.select((f("late_low") - f("on_time_low")).alias("gap"))
    return g.agg(F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"))


def worst_months(kpi: DataFrame, n: int = C.WORST_MONTHS) -> DataFrame:
    """Months with the highest late rate."""
    return (kpi.filter(f("period") != "Total").select("period", "late_rate", "low_score_rate")
            .orderBy(f("late_rate").desc_nulls_last(), f("period")).limit(n))


def outcome_share_known(fact: DataFrame) -> DataFrame:
    """Share pair by outcome with Unknown excluded from the denominators, + pooled problem share."""
    x = fact.filter(f("delivery_outcome") != "Unknown")
    total = _scalar(x, F.count(F.lit(1)))
    total_low = _scalar(x, count_if(f("is_low_score")))
    g = x.groupBy("delivery_outcome", "delivery_outcome_sort").agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"), count_if(f("is_low_score")).alias("low_orders"),
        ratio(count_if(f("is_low_score")), count_if(f("has_review"))).alias("low_share"))
    g = g.select("delivery_outcome", "delivery_outcome_sort", "orders", ratio(f("orders"), total).alias("share_of_orders"),
                 "low_orders", ratio(f("low_orders"), total_low).alias("share_of_low"), "low_share")
    problem = f("delivery_outcome").isin("Late", "Not delivered")
    p_orders = _scalar(x, ratio(count_if(problem), F.count(F.lit(1))))
    p_low = _scalar(x, ratio(count_if(problem & f("is_low_score")), count_if(f("is_low_score"))))
    return g.select("*", p_orders.alias("problem_share_of_orders"), p_low.alias("problem_share_of_low"))


def on_time_order_size(fact: DataFrame) -> DataFrame:
    """On-time orders by order size."""
    return fact.filter(f("delivery_outcome") == "On time").groupBy("order_size").agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"), count_if(f("is_low_score")).alias("low_orders"),
        ratio(count_if(f("is_low_score")), count_if(f("has_review"))).alias("low_share"))


# --- B: composition and categories ---------------------------------------------------------------

def composition(items: DataFrame) -> DataFrame:
    """Order composition class from the item grain (one row per order).

    Only "more than one seller" and "exactly one product" matter, so min/max comparisons replace the
    two distinct counts: plain partial aggregates, one shuffle, no Expand.
    """
    g = items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_n"),
        (F.min("seller_id") != F.max("seller_id")).alias("_several_sellers"),
        (F.min("product_id") == F.max("product_id")).alias("_one_product"))
    (l1, s1), (l2, s2), (l3, s3), (l4, s4) = C.COMPOSITION
    several, one = f("_several_sellers"), f("_one_product")
    label = F.when(f("_n") == 1, l1).when(several, l4).when(one, l2).otherwise(l3)
    sort = F.when(f("_n") == 1, s1).when(several, s4).when(one, s2).otherwise(s3)
    return g.select("order_id", label.alias("composition"), sort.cast("bigint").alias("composition_sort"))


def order_composition(fact: DataFrame, items: DataFrame) -> DataFrame:
    """H8: pack by composition with on-time sub-measures."""
    x = fact.join(composition(items), "order_id", "inner")
    ot = f("delivery_outcome") == "On time"
    return _pack(x, ["composition", "composition_sort"], [
        count_if(ot).alias("on_time_orders"), count_if(ot & f("is_low_score")).alias("on_time_low"),
        ratio(count_if(ot & f("is_low_score")), count_if(ot & f("has_review"))).alias("on_time_low_share")])


def composition_on_time_share(fact: DataFrame, items: DataFrame) -> DataFrame:
    """H9: on-time orders with several items: share of on-time orders (with items) and of their low reviews."""
    c = order_composition(fact, items)
    multi = f("composition_sort") > 1
    low_total = _scalar(fact, count_if((f("delivery_outcome") == "On time") & f("is_low_score")))
    return c.agg(
        F.sum(F.when(multi, f("on_time_orders"))).cast("bigint").alias("multi_on_time_orders"),
        ratio(F.sum(F.when(multi, f("on_time_orders"))), F.sum("on_time_orders")).alias("multi_share_of_on_time"),
        F.sum(F.when(multi, f("on_time_low"))).cast("bigint").alias("multi_on_time_low"),
    ).select("*", low_total.alias("on_time_low_total"),
             ratio(f("multi_on_time_low"), low_total).alias("multi_share_of_on_time_low"))


def distinct_orders(items: DataFrame, key: list[str], flags: dict[str, Column],
                    sums: dict[str, Column] | None = None, tasks: int | None = None) -> DataFrame:
    """count(DISTINCT order_id) FILTER (...) per key, two-phase (flags are constant per order).

    The first phase keeps about as many groups as it reads rows: ``tasks`` deals them by order."""
    phase1 = (items if tasks is None else dealt(items, tasks)).groupBy(*key, "order_id").agg(
        *[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()],
        *[F.sum(c).alias(n) for n, c in (sums or {}).items()])
    return phase1.groupBy(*key).agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"),
        *[F.sum(n).cast("bigint").alias(n) for n in flags],
        *[F.sum(n).alias(n) for n in (sums or {})])


def category_stats(items: DataFrame, products: DataFrame, fact: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per category GMV, share, distinct orders, late rate, low share, clean low share."""
    p = products.select("product_id", "category_en")
    o = fact.select("order_id", "item_count")
    x = items.join(p, "product_id", "inner")
    if tasks is not None:
        x, o = dealt(x, tasks), dealt(o, tasks)
    x = x.join(o, "order_id", "inner")
    clean = (f("delivery_outcome") == "On time") & (f("item_count") == 1)
    g = distinct_orders(x, ["category_en"], {
        "delivered": f("is_delivered"), "late": f("delivery_outcome") == "Late", "reviewed": f("has_review"),
        "low": f("is_low_score"), "clean_low": f("is_low_score") & clean, "clean_reviewed": f("has_review") & clean,
    }, sums={"gmv": f("price")})
    total = _scalar(items, F.sum("price"))
    return g.select("category_en", f("gmv").cast("double").alias("gmv"), ratio(f("gmv"), total).alias("gmv_share"),
                    "orders", ratio(f("late"), f("delivered")).alias("late_rate"),
                    ratio(f("low"), f("reviewed")).alias("low_share"),
                    ratio(f("clean_low"), f("clean_reviewed")).alias("low_share_clean"))


def top_categories_gmv(stats: DataFrame, n: int = C.TOP_CATEGORIES) -> DataFrame:
    """H11 (B2): the largest categories by GMV."""
    return stats.orderBy(f("gmv").desc(), f("category_en")).limit(n)


def worst_categories(stats: DataFrame, n: int = C.WORST_CATEGORIES, min_orders: int = C.CATEGORY_SUPPORT) -> DataFrame:
    """H11 (B3): highest low share among categories with enough orders."""
    return (stats.filter(f("orders") >= min_orders)
            .orderBy(f("low_share").desc_nulls_last(), f("category_en")).limit(n))


def category_clean_range(stats: DataFrame, min_orders: int = C.CATEGORY_SUPPORT) -> DataFrame:
    """Category counts and min/median/max of the clean low share."""
    big = f("orders") >= min_orders
    return stats.agg(F.count(F.lit(1)).cast("bigint").alias("categories"), count_if(big).alias("categories_min"),
                     F.min(F.when(big, f("low_share_clean"))).alias("clean_min"),
                     F.median(F.when(big, f("low_share_clean"))).alias("clean_median"),
                     F.max(F.when(big, f("low_share_clean"))).alias("clean_max"))


def category_flags(stats: DataFrame, overall_low: Column, min_orders: int = C.CATEGORY_SUPPORT,
                   large: float = C.LARGE_CATEGORY_SHARE) -> DataFrame:
    """Large categories with an above-overall low share; the worst one."""
    x = stats.filter((f("orders") >= min_orders) & (f("category_en") != "unknown"))
    worst = _scalar(x, F.max("low_share"))
    return x.select("category_en", "gmv", "low_share", "gmv_share",
                    ((f("gmv_share") >= large) & (f("low_share") > overall_low)).alias("is_flagged"),
                    (f("low_share") == worst).alias("is_worst"))


# --- C: sellers ---------------------------------------------------------------------------------

def seller_stats(items: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct orders per seller: all, delivered, late, reviewed, low."""
    return distinct_orders(items, ["seller_id"], {
        "delivered": f("is_delivered"), "late": f("delivery_outcome") == "Late", "reviewed": f("has_review"),
        "low": f("is_low_score")}, tasks=tasks)


def seller_base(stats: DataFrame, min_orders: int = C.MIN_SELLER_ORDERS) -> DataFrame:
    """Seller count, median orders, sellers above the threshold and their shares."""
    big = f("orders") >= min_orders
    median = quantiles(stats.select("orders"), {"orders": f("orders")}, [0.5]).select(f("q")[0]).scalar()
    return stats.agg(
        F.count(F.lit(1)).cast("bigint").alias("sellers"), median.alias("median_orders"),
        F.sum("orders").cast("bigint").alias("orders"), F.sum("late").cast("bigint").alias("late"),
        F.sum("low").cast("bigint").alias("low"), count_if(big).alias("sellers_min"),
        ratio(F.sum(F.when(big, f("orders"))), F.sum("orders")).alias("share_orders_min"),
        ratio(F.sum(F.when(big, f("late"))), F.sum("late")).alias("share_late_min"),
        ratio(F.sum(F.when(big, f("low"))), F.sum("low")).alias("share_low_min"))


def seller_deciles_volume(stats: DataFrame, buckets: int = C.DECILES) -> DataFrame:
    """Sellers in deciles by order volume (1 = largest) with shares of orders, late, low."""
    r = ntile(stats, buckets, [desc(f("orders")), "seller_id"], "decile")
    t_o, t_l, t_w = (_scalar(stats, F.sum(c)) for c in ("orders", "late", "low"))
    return r.groupBy("decile").agg(
        F.count(F.lit(1)).cast("bigint").alias("sellers"), F.sum("orders").cast("bigint").alias("orders"),
        ratio(F.sum("orders"), t_o).alias("share_orders"), ratio(F.sum("late"), t_l).alias("share_late"),
        ratio(F.sum("low"), t_w).alias("share_low"))


def seller_deciles_late(stats: DataFrame, min_orders: int = C.SELLER_SUPPORT, buckets: int = C.DECILES) -> DataFrame:
    """Sellers with enough orders in deciles by late rate (1 = worst)."""
    s = stats.filter(f("orders") >= min_orders)
    r = ntile(s, buckets, [desc(ratio(f("late"), f("delivered"))), "seller_id"], "decile")
    t_o, t_l = (_scalar(s, F.sum(c)) for c in ("orders", "late"))
    return r.groupBy("decile").agg(
        F.count(F.lit(1)).cast("bigint").alias("sellers"), F.sum("orders").cast("bigint").alias("orders"),
        ratio(F.sum("orders"), t_o).alias("share_orders"), F.sum("late").cast("bigint").alias("late"),
        ratio(F.sum("late"), t_l).alias("share_late"), ratio(F.sum("late"), F.sum("delivered")).alias("late_rate"))


def seller_deciles_low(stats: DataFrame, min_orders: int = C.SELLER_SUPPORT, buckets: int = C.DECILES) -> DataFrame:
    """Sellers with enough orders in deciles by low share (1 = worst)."""
    s = stats.filter(f("orders") >= min_orders)
    r = ntile(s, buckets, [desc(ratio(f("low"), f("reviewed"))), "seller_id"], "decile")
    t_o, t_w = (_scalar(s, F.sum(c)) for c in ("orders", "low"))
    return r.groupBy("decile").agg(
        F.count(F.lit(1)).cast("bigint").alias("sellers"), F.sum("orders").cast("bigint").alias("orders"),
        ratio(F.sum("orders"), t_o).alias("share_orders"), F.sum("low").cast("bigint").alias("low"),
        ratio(F.sum("low"), t_w).alias("share_low"), ratio(F.sum("low"), F.sum("reviewed")).alias("low_share"),
        ratio(F.sum("late"), F.sum("delivered")).alias("late_rate"))


def worst_decile_summary(stats: DataFrame, min_orders: int = C.SELLER_SUPPORT, buckets: int = C.DECILES) -> DataFrame:
    """Worst late-rate decile: sellers, its share of orders and of late orders."""
    s = stats.filter(f("orders") >= min_orders)
    r = ntile(s, buckets, [desc(ratio(f("late"), f("delivered"))), "seller_id"], "decile")
    d1 = f("decile") == 1
    return r.agg(count_if(d1).alias("sellers"),
                 ratio(F.sum(F.when(d1, f("orders"))), F.sum("orders")).alias("share_of_orders"),
                 ratio(F.sum(F.when(d1, f("late"))), F.sum("late")).alias("share_of_late"))


def handover_split(fact: DataFrame) -> DataFrame:
    """Delivered orders with a known handover: in time vs late, late rate and shares."""
    x = fact.filter(f("is_delivered") & f("is_seller_handover_late").isNotNull())
    late_all = _scalar(fact.filter((f("delivery_outcome") == "Late") & f("is_seller_handover_late").isNotNull()),
                       F.count(F.lit(1)))
    after, in_time = C.HANDOVER_LABELS
    label = F.when(f("is_seller_handover_late"), after).otherwise(in_time).alias("handover")
    late = count_if(f("delivery_outcome") == "Late")
    return x.groupBy(label).agg(
        F.count(F.lit(1)).cast("bigint").alias("delivered_orders"), late.alias("late_orders"),
        ratio(late, F.count(F.lit(1))).alias("late_rate"), ratio(late, late_all).alias("share_of_late"),
        ratio(count_if(f("is_low_score")), count_if(f("has_review"))).alias("low_share"))


# --- D: geography -------------------------------------------------------------------------------

def by_region(fact: DataFrame, geo: DataFrame) -> DataFrame:
    """Pack by customer region + median delivery days."""
    return _pack(_with_region(fact, geo), ["region"],
                 [F.median(f("delivery_days").cast("double")).alias("median_delivery_days")])


def by_state_excess(fact: DataFrame, geo: DataFrame, national_late: Column) -> DataFrame:
    """By customer state with the excess late orders over the national late rate."""
    total = _scalar(fact, F.count(F.lit(1)))
    total_late = _scalar(fact, count_if(f("delivery_outcome") == "Late"))
    late = count_if(f("delivery_outcome") == "Late")
    delivered = count_if(f("is_delivered"))
    return _with_region(fact, geo).groupBy("customer_state", "state_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"), ratio(F.count(F.lit(1)), total).alias("share_of_orders"),
        F.median(f("delivery_days").cast("double")).alias("median_days"), delivered.alias("delivered"),
        late.alias("late"), ratio(late, delivered).alias("late_rate"), ratio(late, total_late).alias("share_of_late"),
        (late - delivered * national_late).alias("excess_late"),
        ratio(count_if(f("is_low_score")), count_if(f("has_review"))).alias("low_share"))


def largest_excess_state(states: DataFrame) -> DataFrame:
    """The state with the largest excess of late orders."""
    return states.orderBy(f("excess_late").desc_nulls_last(), f("customer_state")).limit(1).select(
        "customer_state", "state_name", "orders", "late_rate", "excess_late")


def by_seller_state(items: DataFrame, sellers: DataFrame, min_orders: int = C.MIN_SELLER_STATE_ORDERS,
                    tasks: int | None = None) -> DataFrame:
    """By seller state (distinct orders, two-phase), states with enough orders."""
    x = items.join(sellers.select("seller_id", "seller_state"), "seller_id", "inner")
    g = distinct_orders(x, ["seller_state"], {"delivered": f("is_delivered"), "late": f("delivery_outcome") == "Late",
                                              "reviewed": f("has_review"), "low": f("is_low_score")}, tasks=tasks)
    return g.filter(f("orders") >= min_orders).select(
        "seller_state", "orders", ratio(f("late"), f("delivered")).alias("late_rate"),
        ratio(f("low"), f("reviewed")).alias("low_share"))


def same_state_split(fact: DataFrame) -> DataFrame:
    """Same-state vs cross-state shipments (orders with items)."""
    same, diff = C.SHIPMENT_LABELS
    label = F.when(f("is_same_state"), same).otherwise(diff).alias("shipment")
    return _pack(fact.filter(f("has_items")), [label],
                 [F.median(f("delivery_days").cast("double")).alias("median_delivery_days")])


# --- E: price ----------------------------------------------------------------------------------

def value_band(v: Column) -> Column:
    expr = None
    for hi, label in C.VALUE_BANDS:
        expr = F.when(v < hi, label) if expr is None else expr.when(v < hi, label)
    return expr.otherwise(C.VALUE_BAND_OTHER)


def freight_ratio(fact_cols=None) -> Column:
    return F.try_divide(f("freight_value").cast("double"), f("items_value").cast("double"))


def freight_band(r: Column) -> Column:
    expr = None
    for hi, label in C.FREIGHT_BANDS:
        expr = F.when(r < hi, label) if expr is None else expr.when(r < hi, label)
    return expr.otherwise(C.FREIGHT_BAND_OTHER)


def _all_vs_clean(fact: DataFrame, band: Column, sort_value: Column) -> DataFrame:
    x = fact.filter(f("has_items"))
    clean = (f("delivery_outcome") == "On time") & (f("item_count") == 1)
    late = count_if(f("delivery_outcome") == "Late")
    return x.groupBy(band.alias("band")).agg(
        F.min(sort_value).alias("band_min"), F.count(F.lit(1)).cast("bigint").alias("orders"),
        ratio(late, count_if(f("is_delivered"))).alias("late_rate"),
        ratio(count_if(f("is_low_score")), count_if(f("has_review"))).alias("low_share"),
        count_if(clean).alias("orders_clean"),
        ratio(count_if(clean & f("is_low_score")), count_if(clean & f("has_review"))).alias("low_share_clean"))


def value_bands(fact: DataFrame) -> DataFrame:
    """By order value band, all orders with items vs single-item on-time orders."""
    return _all_vs_clean(fact, value_band(f("items_value")), f("items_value").cast("double"))


def freight_ratio_bands(fact: DataFrame) -> DataFrame:
    """By per-order freight/price ratio band, all vs clean."""
    return _all_vs_clean(fact, freight_band(freight_ratio()), freight_ratio())


# --- F: repeat purchase by first order -----------------------------------------------------------

def first_orders(fact: DataFrame, orders: DataFrame) -> DataFrame:
    """Each person's first order (by purchase time, then id): a partial aggregation, no window."""
    o = orders.select("customer_unique_id", "order_id", "order_purchase_timestamp")
    first = o.groupBy("customer_unique_id").agg(
        F.min_by("order_id", F.struct("order_purchase_timestamp", "order_id")).alias("order_id"))
    return fact.join(first.select("order_id"), "order_id", "left_semi")


def repeat_by(first: DataFrame, customers: DataFrame, group: Column, where: Column | None = None) -> DataFrame:
    """H27 + H26: repeat purchase rate by a property of the first order, with a Wilson 95% interval."""
    x = first if where is None else first.filter(where)
    x = x.join(customers.select("customer_unique_id", "is_repeat_customer"), "customer_unique_id", "inner")
    g = x.groupBy(group.alias("first_order")).agg(F.count(F.lit(1)).cast("bigint").alias("customers"),
                                                  count_if(f("is_repeat_customer")).alias("repeat_customers"))
    lo, hi = wilson(f("repeat_customers"), f("customers"))
    return g.select("*", ratio(f("repeat_customers"), f("customers")).alias("repeat_rate"),
                    lo.alias("ci_low"), hi.alias("ci_high"))


def score_class(score: Column) -> Column:
    a, b, c = C.SCORE_CLASSES
    return F.when(score <= C.LOW_SCORE_MAX, a).when(score == 3, b).otherwise(c)


# --- G: robustness of the on-time vs late gap ---------------------------------------------------

def gap_by(fact: DataFrame, group: Column, sort: Column | None = None) -> DataFrame:
    """On-time vs late low share inside groups and the gap in percentage points."""
    x = fact.filter(f("is_delivered") & f("has_items"))
    aggs = _gap_cols()
    if sort is not None:
        aggs.append(F.min(sort).alias("group_min"))
    g = x.groupBy(group.alias("grp")).agg(*aggs)
    return g.select("*", ((f("late_low") - f("on_time_low")) * 100).alias("gap_pp"))


def size_class(n: Column) -> Column:
    one, many = C.SIZE_CLASSES
    return F.when(n == 1, one).otherwise(many)
