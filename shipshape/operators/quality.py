"""Q13-Q32: data-quality checks on the raw layer and on the facts.

Conditions on one relation are counted by one aggregate (``fused``); conditions on groups of its rows
("orders with several reviews") by a second aggregate over one grouping by the key (``totals``). A list
scans each relation once for each key that it groups by. Lists come back as (check_id, label, value)
rows, labels in ``config.CHECK_LABELS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipshape import config as C
from shipshape.functions.exprs import count_if, days_between, has_text, null_splitting_left_join, ratio, varies
from shipshape.operators.quantiles import quantiles
from shipshape.plans.star import Star, in_period, latest_review_per_order

f = F.col


def totals(df: DataFrame, checks: dict[str, Column], labels: dict[str, str] = C.CHECK_LABELS) -> DataFrame:
    """(check_id, label, value): aggregates of one relation, in one aggregation over one scan."""
    one = df.agg(*[F.coalesce(value, F.lit(0)).cast("bigint").alias(f"v{i}") for i, value in enumerate(checks.values())])
    rows = [F.struct(F.lit(cid).alias("check_id"), F.lit(labels[cid]).alias("label"), f(f"v{i}").alias("value")) for i, cid in enumerate(checks)]
    return one.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def fused(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_id, label, value): how many rows of ``df`` meet each condition."""
    return totals(df, {cid: count_if(cond) for cid, cond in checks.items()})


def delivered_view(star: Star) -> DataFrame:
    """Raw orders delivered with a date, with delivery and delay days."""
    o = star.raw["orders"].filter(f("order_status").isin(*C.DELIVERED_STATUSES)
                                  & f("order_delivered_customer_date").isNotNull())
    return o.select("*", days_between(F.to_date("order_purchase_timestamp"),
                                      F.to_date("order_delivered_customer_date")).alias("delivery_days"),
                    days_between(F.to_date("order_estimated_delivery_date"),
                                 F.to_date("order_delivered_customer_date")).alias("delay_days"))


def latest_reviews(star: Star) -> DataFrame:
    """Latest review per order over all raw reviews (max_by, partial aggregation)."""
    r = star.raw["order_reviews_keyed"]
    return latest_review_per_order(r, ["review_id", "review_score", "review_creation_date",
                                       "review_answer_timestamp", "comment_doc_id"])


def scope_checks(star: Star) -> DataFrame:
    """Q13: A1-A9; one aggregate over the orders, one over the latest reviews with their orders."""
    shipped = f("order_status").isin(*C.DELIVERED_STATUSES)
    dated = shipped & f("order_delivered_customer_date").isNotNull()
    p0, p1 = F.lit(C.PERIOD_START).cast("timestamp_ntz"), F.lit(C.PERIOD_END).cast("timestamp_ntz")
    low = f("review_score") <= C.LOW_SCORE_MAX
    reviewed = latest_reviews(star).select("order_id", "review_score").join(star.raw["orders"].select("order_id", "order_status"), "order_id", "left")
    return fused(star.raw["orders"], {
        "A1": (F.lit(True)),
        "A2": (~shipped),
        "A3": (f("order_purchase_timestamp") < p0),
        "A4": (f("order_purchase_timestamp") >= p1),
        "A5": (in_period("order_purchase_timestamp")),
        "A6": (dated & in_period("order_purchase_timestamp")),
        "A7": (dated),
    }).unionByName(fused(reviewed, {
        "A8": (low),
        "A9": (low & ~shipped),
    }))


def review_outcome_by_status(star: Star) -> DataFrame:
    """Q14: orders, reviewed, low reviews and low share by raw status."""
    x = star.raw["orders"].join(latest_reviews(star).withColumn("_r", F.lit(1)), "order_id", "left")
    low = count_if(f("review_score") <= C.LOW_SCORE_MAX)
    return x.groupBy("order_status").agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"), F.count("_r").cast("bigint").alias("with_review"),
        low.alias("low_reviews"), ratio(low, F.count("_r")).alias("low_share"))


def timestamp_checks(star: Star) -> DataFrame:
    """Q15: B1-B15 timestamp-order checks, one aggregate over the orders."""
    shipped = f("order_status").isin(*C.DELIVERED_STATUSES)
    dc, cc, pt, ap = (f(c) for c in ("order_delivered_customer_date", "order_delivered_carrier_date",
                                     "order_purchase_timestamp", "order_approved_at"))
    dated = shipped & dc.isNotNull()
    delay = days_between(F.to_date("order_estimated_delivery_date"), F.to_date(dc))
    return fused(star.raw["orders"], {
        "B1": (shipped & dc.isNull()),
        "B2": (~shipped & dc.isNotNull()),
        "B3": (dc < pt),
        "B4": (dc < cc),
        "B5": (cc < pt),
        "B6": (cc < ap),
        "B7": (ap < pt),
        "B8": (F.to_date("order_estimated_delivery_date") < F.to_date(pt)),
        "B9": (dated & ap.isNull()),
        "B10": (dated & cc.isNull()),
        "B11": (dated & (delay == 0)),
        "B12": (dated & (delay > 0)),
        "B13": (dated & (dc > f("order_estimated_delivery_date"))),
        "B14": (dated & (days_between(F.to_date(pt), F.to_date(dc)) > 60)),
        "B15": (dated & (delay > 30)),
    })


QS = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)
QS_PRICE = (0.25, 0.5, 0.75, 0.95, 0.99, 0.999)


def _qname(q: float) -> str:
    return "p" + f"{q * 100:g}".replace(".", "_")


def distributions(df: DataFrame, columns: list[str], qs, mean: bool = False) -> DataFrame:
    """One row per column: min, exact quantiles, max (and mean), all columns by the same two passes."""
    x = quantiles(df, {c: f(c) for c in columns}, qs)
    return x.select("measure", "min_value", *[f("q")[i].alias(_qname(q)) for i, q in enumerate(qs)], "max_value", *(["mean_value"] if mean else []))


def duration_quantiles(star: Star) -> DataFrame:
    """Q16: delivery and delay days of delivered orders (min, p1..p99, max)."""
    return distributions(delivered_view(star), ["delivery_days", "delay_days"], QS)


def value_checks(star: Star) -> DataFrame:
    """Q17: C1-C4 in one aggregate over the items, C8 and C9 in one over the payments."""
    return fused(star.raw["order_items"], {
        "C1": (f("price") <= 0),
        "C2": (f("freight_value") == 0),
        "C3": (f("freight_value") > f("price")),
        "C4": (f("price") > 100000),
    }).unionByName(fused(star.raw["order_payments"], {
        "C8": (f("payment_value") == 0),
        "C9": (f("payment_type") == "not_defined"),
    }))


def payment_reconciliation(star: Star) -> DataFrame:
    """Q18: C5-C7, orders with items and payments, totals differing by > 0.01 and > 1.00."""
    i = star.raw["order_items"].groupBy("order_id").agg(F.sum(f("price") + f("freight_value")).alias("items_total"))
    p = star.raw["order_payments"].groupBy("order_id").agg(F.sum("payment_value").alias("paid_total"))
    diff = F.abs(f("items_total") - f("paid_total"))
    return fused(i.join(p, "order_id", "inner"), {
        "C5": (F.lit(True)),
        "C6": (diff > 0.01),
        "C7": (diff > 1.00),
    })


def price_quantiles(star: Star) -> DataFrame:
    """Q19: price and freight distribution incl. mean and p99.9."""
    return distributions(star.raw["order_items"], ["price", "freight_value"], QS_PRICE, mean=True)


def top5_price(star: Star, n: int = 5) -> DataFrame:
    """Q20: most expensive item rows with category and status."""
    x = (star.raw["order_items"].join(star.raw["products"], "product_id", "inner")
         .join(star.raw["orders"].select("order_id", "order_status"), "order_id", "inner"))
    x = x.select(f("price").cast("double").alias("price"), f("freight_value").cast("double").alias("freight_value"),
                 F.coalesce(f("product_category_name"), F.lit("(no category)")).alias("category"), "order_status")
    return x.orderBy(f("price").desc(), f("freight_value").desc(), "category", "order_status").limit(n)


def top5_freight(star: Star, n: int = 5) -> DataFrame:
    """Q20: highest freight item rows with category and weight."""
    x = star.raw["order_items"].join(star.raw["products"], "product_id", "inner")
    x = x.select(f("freight_value").cast("double").alias("freight_value"), f("price").cast("double").alias("price"),
                 F.coalesce(f("product_category_name"), F.lit("(no category)")).alias("category"), "product_weight_g")
    return x.orderBy(f("freight_value").desc(), f("price").desc(), "category", "product_weight_g").limit(n)


def duplicate_reviews(star: Star) -> DataFrame:
    """Q21: D1-D5, D11; reviews and orders meet in one grouping by order, neither is joined."""
    none = F.lit(None).cast("bigint")
    r = star.raw["order_reviews_keyed"].select("order_id", f("review_score").alias("score"), F.lit(1).alias("review"), F.lit(0).alias("placed"))
    o = star.raw["orders"].select("order_id", none.alias("score"), F.lit(0).alias("review"), F.lit(1).alias("placed"))
    n = f("reviews")
    by_order = r.unionByName(o).groupBy("order_id").agg(F.sum("review").alias("reviews"), F.sum("placed").alias("orders"), varies("score").alias("unlike"))
    return totals(by_order, {
        "D1": F.sum(n), "D2": count_if((n > 0) & f("order_id").isNotNull()), "D3": count_if(n > 1), "D4": count_if((n > 1) & f("unlike")),
        "D5": F.sum(n) - count_if(n > 0), "D11": F.sum(F.when(n == 0, f("orders")))})


def comment_digests(star: Star) -> DataFrame:
    """comment_doc_id, digest, blank, words: what the checks need of a comment, without its text."""
    text = f("text")
    return star.tables.documents.select(f("doc_id").alias("comment_doc_id"), F.md5(text).alias("digest"),
                                        (text.isNotNull() & ~has_text(text)).alias("blank"), has_text(text).alias("words"))


def reviews_with_digests(star: Star) -> DataFrame:
    return null_splitting_left_join(star.raw["order_reviews_keyed"], comment_digests(star), "comment_doc_id")


def shared_review_ids(star: Star) -> DataFrame:
    """Q22: D6-D9, review ids shared by several orders; one grouping by id, comments compared by digest."""
    people = (star.raw["orders"].select("order_id", "customer_id").join(star.raw["customers"].select("customer_id", "customer_unique_id"), "customer_id", "inner")
              .groupBy("order_id").agg(F.min("customer_unique_id").alias("low"), F.max("customer_unique_id").alias("high")))
    r = reviews_with_digests(star).select("review_id", "order_id", "review_score", F.coalesce("digest", F.md5(F.lit(""))).alias("digest"))
    known = F.when(f("low").isNotNull(), f("order_id"))
    by_id = r.join(people, "order_id", "left").groupBy("review_id").agg(
        F.count(F.lit(1)).alias("n"), varies("order_id").alias("shared"), (varies("review_score") | varies("digest")).alias("unlike"),
        (varies(known) & (F.min("low") != F.max("high"))).alias("several"))
    shared = f("shared")
    return totals(by_id, {"D6": count_if(shared), "D7": F.sum(F.when(shared, f("n"))), "D8": count_if(shared & f("unlike")), "D9": count_if(f("several"))})


def comment_checks(star: Star) -> DataFrame:
    """Q23: D10 blank comments, D13 distinct low + commented review ids; one grouping by id."""
    low = (f("review_score") <= C.LOW_SCORE_MAX) & f("words")
    by_id = reviews_with_digests(star).groupBy("review_id").agg(count_if(f("blank")).alias("blank"), count_if(low).alias("low"))
    return totals(by_id, {"D10": F.sum("blank"), "D13": count_if((f("low") > 0) & f("review_id").isNotNull())})


def survey_timing(star: Star) -> DataFrame:
    """Q24: D12, D14-D18 (answered before delivery; survey windows), one aggregate."""
    x = delivered_view(star).join(latest_reviews(star), "order_id", "inner")
    sent = F.to_date("review_creation_date")
    on, late = f("delay_days") <= 0, f("delay_days") > 0
    return fused(x, {
        "D12": (f("review_answer_timestamp") < f("order_delivered_customer_date")),
        "D14": (on),
        "D15": (on & days_between(F.to_date("order_delivered_customer_date"), sent).between(0, 1)),
        "D16": (late),
        "D17": (late & days_between(F.to_date("order_estimated_delivery_date"), sent).between(0, 3)),
        "D18": (late & (sent < F.to_date("order_delivered_customer_date"))),
    })


def review_gaps_by_outcome(star: Star) -> DataFrame:
    """Q25: delivered orders without a review / answered early, late vs on time."""
    x = delivered_view(star).join(latest_reviews(star).withColumn("_r", F.lit(1)), "order_id", "left")
    early = count_if(f("review_answer_timestamp") < f("order_delivered_customer_date"))
    none = count_if(f("_r").isNull())
    return x.groupBy(F.when(f("delay_days") > 0, "late").otherwise("on time").alias("outcome")).agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"), none.alias("no_review"),
        ratio(none, F.count(F.lit(1))).alias("no_review_share"), early.alias("early"),
        ratio(early, F.count("_r")).alias("early_share"))


def review_gaps_by_status(star: Star) -> DataFrame:
    """Q26: orders without review by status."""
    x = star.raw["orders"].join(latest_reviews(star).withColumn("_r", F.lit(1)), "order_id", "left")
    none = count_if(f("_r").isNull())
    return x.groupBy("order_status").agg(F.count(F.lit(1)).cast("bigint").alias("orders"), none.alias("no_review"),
                                         ratio(none, F.count(F.lit(1))).alias("no_review_share"))


def entity_checks(star: Star) -> DataFrame:
    """Q27: E1-E10; one grouping of items by order, of customers by person, one aggregate of sellers."""
    r = star.raw
    products = (r["products"].select("product_id", "product_category_name")
                .join(r["category_translation"].select("product_category_name", F.lit(True).alias("translated")), "product_category_name", "left")
                .select("product_id", f("product_category_name").alias("category"), "translated", F.lit(True).alias("product")))
    places = r["geolocation"].select(f("geolocation_zip_code_prefix").alias("zip")).distinct().withColumn("place", F.lit(True))
    has, lacks = f("product"), f("category").isNull()
    items = r["order_items"].join(products, "product_id", "left").groupBy("order_id").agg(
        varies("seller_id").alias("sellers"), count_if(has & lacks).alias("bare"), count_if(has & ~lacks & f("translated").isNull()).alias("foreign"),
        varies(F.when(has, F.coalesce("category", F.lit("(no category)")))).alias("categories"))

    def empty(c: str) -> Column:
        return f(c).isNull() | (F.trim(f(c)) == "")
    customers = r["customers"].join(places, f("customer_zip_code_prefix") == f("zip"), "left").groupBy("customer_unique_id").agg(
        varies("customer_state").alias("states"), count_if(f("place").isNull()).alias("lost"), count_if(empty("customer_state")).alias("empty"))
    sellers = r["sellers"].join(places, f("seller_zip_code_prefix") == f("zip"), "left")
    return (fused(r["order_items"], {"E1": F.lit(True)})
            .unionByName(totals(items, {"E2": F.sum("bare"), "E3": F.sum("foreign"), "E4": count_if(f("sellers")), "E5": count_if(f("categories"))}))
            .unionByName(totals(customers, {"E6": count_if(f("states")), "E7": F.sum("lost"), "E9": F.sum("empty")}))
            .unionByName(fused(sellers, {"E8": f("place").isNull(), "E10": empty("seller_state")})))


def value_without_category(star: Star) -> DataFrame:
    """Q28: item rows and value by category class, with the share of total value."""
    r = star.raw
    t = r["category_translation"].select("product_category_name", F.lit(1).alias("_t"))
    x = r["order_items"].join(r["products"], "product_id", "inner").join(t, "product_category_name", "left")
    grp = (F.when(f("product_category_name").isNull(), "no category")
           .when(f("_t").isNull(), "category without translation").otherwise("category with translation"))
    total = r["order_items"].agg(F.sum("price")).scalar()
    return x.groupBy(grp.alias("category_class")).agg(
        F.count(F.lit(1)).cast("bigint").alias("item_rows"), F.sum("price").cast("double").alias("price_total"),
        ratio(F.sum("price"), total).alias("price_share"))


def fact_fill(fact: DataFrame) -> DataFrame:
    """Q29: filled and NULL rows of every fact column (one pass, unpivoted)."""
    cols = fact.columns
    one = fact.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    parts = ", ".join(f"'{c}', c{i}" for i, c in enumerate(cols))
    x = one.selectExpr("_n", f"stack({len(cols)}, {parts}) AS (column_name, filled)")
    return x.select("column_name", f("filled").cast("bigint").alias("filled"), (f("_n") - f("filled")).cast("bigint").alias("nulls"))


def flag_tristate(fact: DataFrame) -> DataFrame:
    """Q30: true / false / NULL counts of the three-valued flags (orders with items)."""
    x = fact.filter(f("has_items"))
    flags = [("is_seller_handover_late", f("is_seller_handover_late")), ("is_same_state", f("is_same_state")),
             ("seller_count > 1", F.when(f("seller_count").isNotNull(), f("seller_count") > 1))]
    aggs = []
    for i, (_, c) in enumerate(flags):
        aggs += [count_if(c).alias(f"t{i}"), count_if(~c).alias(f"f{i}"), count_if(c.isNull()).alias(f"n{i}")]
    parts = ", ".join(f"'{name}', t{i}, f{i}, n{i}" for i, (name, _) in enumerate(flags))
    return x.agg(*aggs).selectExpr(f"stack({len(flags)}, {parts}) AS (flag, true_rows, false_rows, null_rows)")


def repeat_definitions(dim_customer: DataFrame) -> DataFrame:
    """Q31: people, more than one order, orders on more than one day."""
    return dim_customer.agg(F.count(F.lit(1)).cast("bigint").alias("people"),
                            count_if(f("order_count") > 1).alias("more_than_one_order"),
                            count_if(f("is_repeat_customer")).alias("repeat_customers"))


def outcome_band_contents(fact: DataFrame) -> DataFrame:
    """Q32: outcome x band: orders, with review, with items."""
    return fact.groupBy("delivery_outcome", "delay_band", "delay_band_sort").agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"), count_if(f("has_review")).alias("with_review"),
        count_if(f("has_items")).alias("with_items"))
