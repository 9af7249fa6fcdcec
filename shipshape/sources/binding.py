"""Binding of the driver tables to the raw order model.

The raw layer has the shape of a marketplace export: orders, order_items, order_payments,
order_reviews, customers, sellers, products, category_translation and a geography reference.
Each function returns a lazy DataFrame; nothing is collected. The rules are in FIXTURES.md §3 and
their constants in :mod:`shipshape.config`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from shipshape import config as C
from shipshape.functions.exprs import null_splitting_left_join
from shipshape.sources import tables
from shipshape.sources.tables import Tables


def _days_after(date_col: Column, days: Column) -> Column:
    return F.date_add(date_col, days.cast("int"))


def _ts(date_col: Column) -> Column:
    return date_col.cast("timestamp_ntz")


def dealt(df: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt by order to that many tasks. Exchanges left to the adaptive plan are merged up to a
    number of bytes; keys in sequence compress so well that such a task holds millions of rows."""
    return df.repartition(tasks, "order_id")


def merged(t: Tables, df: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt for a join by order. With many orders sorted rows are merged: the planner takes a table's size
    from the bytes of its compressed files and would else send millions of orders to every task."""
    return dealt(df, tasks).hint("merge") if t.rows("orders") > tables.SENT_ROWS else dealt(df, tasks)


def ship_window(t: Tables, tasks: int) -> DataFrame:
    """First and last ship date per order, by tasks of :func:`dealt`: rows are dealt before they are grouped,
    since a scan task's own groups would be nearly as many as its rows. Items without an order match none."""
    li = t.lineitem.select(F.col("l_orderkey").alias("order_id"), "l_shipdate").filter(F.col("order_id").isNotNull())
    return (dealt(li, tasks).groupBy("order_id")
            .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")))


def placed_orders(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.col("o_orderpriority"))


def raw_orders(t: Tables, tasks: int | None = None, placed: DataFrame | None = None) -> DataFrame:
    """Orders with the dates derived from their ship dates; ``placed``: some of them, with further columns."""
    o = placed_orders(t) if placed is None else placed
    more = [c for c in o.columns if c not in ("order_id", "customer_id", "order_status", "order_purchase_timestamp", "o_orderpriority")]
    purchase = F.to_date("order_purchase_timestamp")
    g = F.datediff(F.to_date("last_ship"), purchase)
    h = F.datediff(F.to_date("first_ship"), purchase)
    prio = F.substring("o_orderpriority", 1, 1).cast("int")
    n = tasks or t.tasks("orders", "lineitem")
    return (merged(t, o, n).join(ship_window(t, n), "order_id", "left")
            .select(
                "order_id", "customer_id", *more, "order_status", "order_purchase_timestamp",
                F.when(F.col("order_status") != "P", F.col("order_purchase_timestamp")).alias("order_approved_at"),
                _ts(_days_after(purchase, F.pmod(h, F.lit(C.HANDOVER_SPREAD_DAYS)))).alias("order_delivered_carrier_date"),
                _ts(_days_after(purchase, F.pmod(g, F.lit(C.DELIVERY_SPREAD_DAYS)))).alias("order_delivered_customer_date"),
                _ts(_days_after(purchase, F.lit(C.PROMISE_BASE_DAYS) + F.lit(C.PROMISE_STEP_DAYS) * prio))
                .alias("order_estimated_delivery_date")))


def item_money(price_double: Column, tax_double: Column) -> tuple[Column, Column]:
    """Price and freight as decimals; cast each operand first, then multiply (exact cents)."""
    price = price_double.cast("decimal(12,2)")
    freight = (price * tax_double.cast("decimal(4,2)")).cast("decimal(12,2)")
    return price, freight


def raw_order_items(t: Tables, tasks: int | None = None) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("order_id"),
                        F.to_date("o_orderdate").alias("_purchase_date"))
    li = t.lineitem.select(F.col("l_orderkey").alias("order_id"), "l_linenumber", "l_partkey", "l_suppkey",
                           "l_extendedprice", "l_tax")
    price, freight = item_money(F.col("l_extendedprice"), F.col("l_tax"))
    n = tasks or t.tasks("orders", "lineitem")
    return (dealt(li, n).join(merged(t, o, n), "order_id", "inner")
            .select("order_id",
                    F.col("l_linenumber").cast("bigint").alias("order_item_id"),
                    F.col("l_partkey").alias("product_id"),
                    F.col("l_suppkey").alias("seller_id"),
                    _ts(_days_after(F.col("_purchase_date"),
                                    F.lit(C.SHIP_LIMIT_BASE_DAYS) + F.col("l_linenumber"))).alias("shipping_limit_date"),
                    price.alias("price"), freight.alias("freight_value")))


def raw_order_payments(t: Tables) -> DataFrame:
    """One payment per order with items (+ surcharge), a second 'voucher' row on the second modulus."""
    li = t.lineitem.select(F.col("l_orderkey").alias("order_id"), "l_extendedprice", "l_tax")
    price, freight = item_money(F.col("l_extendedprice"), F.col("l_tax"))
    totals = li.groupBy("order_id").agg(F.sum(price + freight).alias("_items_total"))
    (m1, a1), (m2, a2) = C.PAYMENT_SURCHARGES
    oid = F.col("order_id")
    ptype = (F.when(oid % C.PAYMENT_UNDEFINED_MOD == 0, F.lit("not_defined"))
             .otherwise(F.element_at(F.array(*[F.lit(x) for x in C.PAYMENT_TYPES]),
                                     (oid % len(C.PAYMENT_TYPES) + 1).cast("int"))))
    first = totals.select(
        "order_id", F.lit(1).cast("bigint").alias("payment_sequential"), ptype.alias("payment_type"),
        (oid % C.PAYMENT_INSTALLMENT_MOD).cast("bigint").alias("payment_installments"),
        (F.col("_items_total") + F.when(oid % m1 == 0, F.lit(a1).cast("decimal(4,2)"))
         .otherwise(F.lit("0").cast("decimal(4,2)"))).cast("decimal(12,2)").alias("payment_value"))
    second = totals.filter(oid % m2 == 0).select(
        "order_id", F.lit(2).cast("bigint").alias("payment_sequential"), F.lit("voucher").alias("payment_type"),
        F.lit(1).cast("bigint").alias("payment_installments"), F.lit(a2).cast("decimal(12,2)").alias("payment_value"))
    return first.unionByName(second)


def comment_texts(t: Tables) -> DataFrame:
    """doc_id -> text, the pool of free-text review comments."""
    return t.documents.select("doc_id", "text")


def raw_order_reviews_keyed(t: Tables, tasks: int | None = None) -> DataFrame:
    """Reviews derived from the event stream, with the comment as a document key.

    order = event_id (+1 when event_id mod 5 = 0), review id = event_id div 2 (shared ids), score from
    the event value, survey date = purchase date + event_id mod 60 days, answered on that day at the
    event's time of day; comment = the document order_id div 15 when order_id mod 5 < 2.
    """
    e = t.events.select("event_id", "ts", "value")
    oid = F.when(F.col("event_id") % C.REVIEW_SHIFT_EVERY == 0, F.col("event_id") + 1).otherwise(F.col("event_id"))
    o = t.orders.select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("_purchase_date"))
    n = tasks or t.tasks("orders", "events")
    e = (e.select(F.floor(F.col("event_id") / 2).cast("bigint").alias("review_id"), oid.alias("order_id"),
                  (F.floor("value").cast("bigint") % 5 + 1).alias("review_score"), "event_id", "ts"))
    r = dealt(e, n).join(merged(t, o, n), "order_id", "left")
    created = _ts(_days_after(F.col("_purchase_date"), F.col("event_id") % C.SURVEY_SPREAD_DAYS))
    time_of_day = F.col("ts") - F.date_trunc("DAY", F.col("ts")).cast("timestamp_ntz")
    has = (F.col("order_id") % C.COMMENT_MOD) < C.COMMENT_BELOW
    return r.select("review_id", "order_id", "review_score",
                    F.lit(None).cast("string").alias("review_comment_title"),
                    F.when(has, F.floor(F.col("order_id") / C.COMMENT_DOC_STRIDE).cast("bigint")).alias("comment_doc_id"),
                    created.alias("review_creation_date"),
                    (created + time_of_day).alias("review_answer_timestamp"))


def attach_comment(df: DataFrame, t: Tables, out: str = "review_comment_message", clean=None) -> DataFrame:
    """Join the comment text by document key (only where the text itself is needed)."""
    docs = comment_texts(t).select(F.col("doc_id").alias("comment_doc_id"), F.col("text"))
    text = F.col("text") if clean is None else clean(F.col("text"))
    return null_splitting_left_join(df, docs, "comment_doc_id").withColumn(out, text).drop("text")


def comment_flags(t: Tables, present) -> DataFrame:
    """doc key -> has a usable (non-blank) comment; a boolean instead of the text for flags.

    ``present(text)`` decides it without copying the text (see ``exprs.has_text``).
    """
    return comment_texts(t).select(F.col("doc_id").alias("comment_doc_id"),
                                   present(F.col("text")).alias("comment_present"))


def raw_order_reviews(t: Tables) -> DataFrame:
    r = raw_order_reviews_keyed(t)
    return attach_comment(r, t).select("review_id", "order_id", "review_score", "review_comment_title",
                                       "review_comment_message", "review_creation_date", "review_answer_timestamp")


def geography(t: Tables) -> DataFrame:
    """State reference: one row per nation with its region (the dim_geography source)."""
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    return (n.join(r, n.n_regionkey == r.r_regionkey, "left")
            .select(F.col("n_name").alias("state_code"), F.col("n_name").alias("state_name"),
                    F.col("r_name").alias("region"), F.col("n_nationkey").alias("_nationkey")))


def _state_of(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("_nationkey"), F.col("n_name").alias("_state"))


def raw_customers(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return (c.join(_state_of(t), c.c_nationkey == F.col("_nationkey"), "left")
            .select(F.col("c_custkey").alias("customer_id"), F.col("c_custkey").alias("customer_unique_id"),
                    F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("customer_zip_code_prefix"),
                    F.col("c_mktsegment").alias("customer_city"), F.col("_state").alias("customer_state")))


def raw_sellers(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    return (s.join(_state_of(t), s.s_nationkey == F.col("_nationkey"), "left")
            .select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("seller_name"),
                    F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("seller_zip_code_prefix"),
                    F.lit(None).cast("string").alias("seller_city"), F.col("_state").alias("seller_state")))


def sent_sellers(t: Tables, sellers: DataFrame) -> DataFrame:
    """Sellers for a join with the items: up to some number their states are sent to every task. The planner
    takes the product of supplier's and nation's bytes for their size and would else shuffle all items by seller."""
    s = sellers.select("seller_id", "seller_state")
    return F.broadcast(s) if t.rows("supplier") <= tables.SENT_SELLERS else s


def raw_products(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    cat = F.when(F.col("p_brand") != C.BRAND_WITHOUT_CATEGORY, F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("product_id"), cat.alias("product_category_name"),
                    F.col("p_size").cast("bigint").alias("product_weight_g"))


def english_name(brand: Column) -> Column:
    """Rule for the translation list: Brand#7 -> brand_07."""
    return F.concat(F.lit("brand_"), F.lpad(F.substring(brand, 7, 10), 2, "0"))


def raw_category_translation(t: Tables) -> DataFrame:
    """Translation list built from the categories in use, minus the untranslated ones."""
    cats = (t.part.select(F.col("p_brand").alias("product_category_name")).distinct()
            .filter(F.col("product_category_name") != C.BRAND_WITHOUT_CATEGORY)
            .filter(~F.col("product_category_name").isin(*C.UNTRANSLATED_BRANDS)))
    return cats.select("product_category_name",
                       english_name(F.col("product_category_name")).alias("product_category_name_english"))


def raw_geolocation(t: Tables) -> DataFrame:
    """Zip-prefix lookup: one row per nation (prefix = zero-padded nation key)."""
    return t.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("geolocation_zip_code_prefix"),
                           F.lit(None).cast("string").alias("geolocation_city"),
                           F.col("n_name").alias("geolocation_state"))


RAW_BUILDERS = {
    "orders": raw_orders, "order_items": raw_order_items, "order_payments": raw_order_payments,
    "order_reviews": raw_order_reviews, "customers": raw_customers, "sellers": raw_sellers,
    "products": raw_products, "category_translation": raw_category_translation, "geolocation": raw_geolocation,
    "order_reviews_keyed": raw_order_reviews_keyed,
}


class RawLayer(Mapping):
    """The raw tables as a read-only mapping whose plans are built on first access (a query that
    needs two raw tables does not pay for analysing all ten)."""

    def __init__(self, t: Tables):
        self._t = t
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = RAW_BUILDERS[name](self._t)
        return self._built[name]

    def dealt(self, name: str, tasks: int) -> DataFrame:
        """A raw table of orders, items or reviews whose joins by order have that many tasks."""
        return RAW_BUILDERS[name](self._t, tasks)

    def __iter__(self):
        return iter(RAW_BUILDERS)

    def __len__(self) -> int:
        return len(RAW_BUILDERS)


def raw_tables(t: Tables) -> RawLayer:
    return RawLayer(t)
