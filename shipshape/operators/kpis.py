"""K1-K7: KPI cube (month + total, rolled up from one aggregation), customer KPIs, KPI sheet and the
standard measure pack reused by every cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipshape.functions.exprs import count_if, one_row, ratio
from shipshape.operators.quantiles import quantiles


def _roll_up(parts: DataFrame, *group: str) -> DataFrame:
    """The order KPIs from partial sums by (month, delivery days, late delay); without a group one row, on empty input too."""
    f = F.col

    def count(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    def mean(days: str, where: Column) -> Column:
        return F.try_divide(F.sum(F.when(where, f(days) * f("orders"))).cast("double"), F.sum(F.when(where, f("orders"))).cast("double"))

    def median(days: str) -> Column:
        return F.percentile(f(days).cast("double"), 0.5, f("orders"))

    return parts.groupBy(*group).agg(
        count("orders").alias("orders"), count("orders_with_items").alias("orders_with_items"),
        F.sum("gmv").cast("double").alias("gmv"), ratio(F.sum("gmv"), F.sum("orders_with_items")).alias("avg_order_value"),
        F.sum("freight").cast("double").alias("freight_total"), ratio(F.sum("freight"), F.sum("total")).alias("freight_share"),
        *[count(c).alias(c) for c in ("delivered_orders", "on_time_orders", "late_orders", "not_delivered_orders")],
        ratio(F.sum("on_time_orders"), F.sum("delivered_orders")).alias("on_time_rate"),
        ratio(F.sum("late_orders"), F.sum("delivered_orders")).alias("late_rate"),
        ratio(F.sum("not_delivered_orders"), F.sum("orders")).alias("not_delivered_rate"),
        mean("late_delay", f("late_delay").isNotNull()).alias("avg_delay_days_late"), median("late_delay").alias("median_delay_days_late"),
        mean("delivery_days", f("delivery_days").isNotNull()).alias("avg_delivery_days"), median("delivery_days").alias("median_delivery_days"),
        count("reviewed_orders").alias("reviewed_orders"), ratio(F.sum("scores"), F.sum("scored")).alias("avg_review_score"),
        count("low_score_orders").alias("low_score_orders"), ratio(F.sum("low_score_orders"), F.sum("reviewed_orders")).alias("low_score_rate"),
        count("commented_orders").alias("commented_orders"), ratio(F.sum("commented_orders"), F.sum("reviewed_orders")).alias("comment_rate"))


def kpi_orders(fact_orders: DataFrame, dim_date: DataFrame) -> DataFrame:
    """K1: one row per month plus a 'Total' row; on empty input the Total row alone.

    The fact is aggregated once by (month, delivery days, late delay), a few thousand rows whatever
    its size; months and total (medians too) are rolled up from these.
    """
    f = F.col
    outcome = f("delivery_outcome")
    d = dim_date.select(f("date_day").alias("purchase_date"), "year_month")
    parts = fact_orders.join(d, "purchase_date", "inner").groupBy(
        "year_month", "delivery_days", F.when(outcome == "Late", f("delay_days")).alias("late_delay")).agg(
        F.count(F.lit(1)).alias("orders"), count_if(f("has_items")).alias("orders_with_items"),
        F.sum("items_value").alias("gmv"), F.sum("freight_value").alias("freight"), F.sum("order_total").alias("total"),
        count_if(f("is_delivered")).alias("delivered_orders"), count_if(outcome == "On time").alias("on_time_orders"),
        count_if(outcome == "Late").alias("late_orders"), count_if(outcome == "Not delivered").alias("not_delivered_orders"),
        count_if(f("has_review")).alias("reviewed_orders"), F.sum("review_score").alias("scores"), F.count("review_score").alias("scored"),
        count_if(f("is_low_score")).alias("low_score_orders"), count_if(f("has_comment")).alias("commented_orders"))
    months = _roll_up(parts, "year_month").withColumnRenamed("year_month", "period")
    return months.unionByName(_roll_up(parts).withColumn("period", F.lit("Total")))


def kpi_customers(dim_customer: DataFrame) -> DataFrame:
    """K2: customers, repeat customers and the repeat purchase rate (whole period)."""
    rep = count_if(F.col("is_repeat_customer"))
    return dim_customer.agg(F.count(F.lit(1)).cast("bigint").alias("customers"), rep.alias("repeat_customers"),
                            ratio(rep, F.count(F.lit(1))).alias("repeat_purchase_rate"))


def order_measures() -> list[Column]:
    """K7: the pack reused by every cut: orders, late rate, reviewed, avg score, low reviews, low share."""
    f = F.col
    delivered = count_if(f("is_delivered"))
    late = count_if(f("delivery_outcome") == "Late")
    reviewed = count_if(f("has_review"))
    low = count_if(f("is_low_score"))
    return [
        F.count(F.lit(1)).cast("bigint").alias("orders"), ratio(late, delivered).alias("late_rate"),
        reviewed.alias("reviewed"), F.avg(f("review_score").cast("double")).alias("avg_score"),
        low.alias("low_reviews"), ratio(low, reviewed).alias("low_share"),
    ]


def kpi_sheet(kpi: DataFrame, customers: DataFrame) -> DataFrame:
    """K3: the KPI sheet, one row per KPI with value, numerator and denominator (unpivot)."""
    t = kpi.filter(F.col("period") == "Total")
    c = customers
    r = one_row(c)
    x = t.select("*", *[r[n].alias(n) for n in c.columns])
    rows = [
        ("Number of orders", "orders", None, None),
        ("GMV", "gmv", None, None),
        ("Average order value", "avg_order_value", "gmv", "orders_with_items"),
        ("Freight share of order value", "freight_share", "freight_total", "(gmv + freight_total)"),
        ("On-time delivery rate", "on_time_rate", "on_time_orders", "delivered_orders"),
        ("Late delivery rate", "late_rate", "late_orders", "delivered_orders"),
        ("Not-delivered rate", "not_delivered_rate", "not_delivered_orders", "orders"),
        ("Average delay, late orders only", "avg_delay_days_late", None, "late_orders"),
        ("Median delay, late orders only", "median_delay_days_late", None, "late_orders"),
        ("Average delivery time", "avg_delivery_days", None, "delivered_orders"),
        ("Median delivery time", "median_delivery_days", None, "delivered_orders"),
        ("Average review score", "avg_review_score", None, "reviewed_orders"),
        ("Share of 1-2 star reviews", "low_score_rate", "low_score_orders", "reviewed_orders"),
        ("Share of reviews with a written comment", "comment_rate", "commented_orders", "reviewed_orders"),
        ("Repeat purchase rate", "repeat_purchase_rate", "repeat_customers", "customers"),
    ]
    parts = ", ".join(
        f"'{label}', CAST({v} AS DOUBLE), CAST({n or 'NULL'} AS DOUBLE), CAST({d or 'NULL'} AS DOUBLE)"
        for label, v, n, d in rows)
    return x.selectExpr(f"stack({len(rows)}, {parts}) AS (kpi, value, numerator, denominator)")


def supporting_figures(fact: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """K4: figures behind the KPIs (one row)."""
    f = F.col
    nd = f("delivery_outcome") == "Not delivered"
    s = fact.agg(
        F.sum(F.when(nd, f("items_value"))).cast("double").alias("gmv_not_delivered"),
        count_if(nd & f("has_items")).alias("not_delivered_with_items"),
        F.sum("items_value").cast("double").alias("gmv"),
        count_if(~f("has_items")).alias("orders_without_items"),
        count_if(~f("has_review")).alias("orders_without_review"),
        count_if(f("delivery_outcome") == "Unknown").alias("unknown_outcome"),
        F.median(f("delay_days").cast("double")).alias("median_delay_all_delivered"))
    # day counts have few distinct values (built-in median is fine); order values do not
    s = s.select("*", quantiles(fact, {"value": F.col("items_value")}, [0.5]).select(F.col("q")[0]).scalar().alias("median_order_value"))
    multi = count_if(f("order_count") > 1)
    r = dim_customer.agg(multi.alias("multi_order_customers"), ratio(multi, F.count(F.lit(1))).alias("multi_order_rate"))
    one = one_row(r)
    return s.select("*", ratio(f("gmv_not_delivered"), f("gmv")).alias("gmv_not_delivered_share"),
                    one["multi_order_customers"].alias("multi_order_customers"),
                    one["multi_order_rate"].alias("multi_order_rate"))


def score_distribution(fact: DataFrame) -> DataFrame:
    """K5: reviewed orders by score with the share of all reviewed orders."""
    g = fact.filter(F.col("has_review")).groupBy("review_score").agg(F.count(F.lit(1)).cast("bigint").alias("orders"))
    total = fact.filter(F.col("has_review")).agg(F.count(F.lit(1))).scalar()
    return g.select("review_score", "orders", ratio(F.col("orders"), total).alias("share_of_reviewed"))


MONTHLY_COLUMNS = ["period", "orders", "gmv", "avg_order_value", "freight_share", "on_time_rate", "late_rate",
                   "not_delivered_rate", "avg_delay_days_late", "median_delivery_days", "avg_review_score",
                   "low_score_rate", "comment_rate"]


def kpi_monthly(kpi: DataFrame) -> DataFrame:
    """K6: the monthly sheet (total row excluded)."""
    return kpi.filter(F.col("period") != "Total").select(*MONTHLY_COLUMNS)
