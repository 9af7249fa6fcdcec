"""Q1-Q12: profiling of the raw layer.

Every per-table statistic is one aggregation pass (all columns' nulls, first example, min, max in a
single ``agg``), unpivoted afterwards with ``stack``, and one pass of digests for the distinct counts; key and relationship
checks take one grouping per candidate or one join of keys per relation; trap counts take one aggregate
for each relation and grouping key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shipshape import config as C
from shipshape.functions.exprs import count_if, ratio, unicode_trim, varies
from shipshape.operators.quality import reviews_with_digests, totals
from shipshape.plans.star import Star

f = F.col
PROFILED = ("orders", "order_items", "order_payments", "order_reviews", "customers", "sellers", "products",
            "category_translation", "geolocation")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_overview(star: Star, tables=PROFILED) -> DataFrame:
    """Q1: rows and columns per raw table."""
    return _union([star.raw[t].agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(
        F.lit(f"raw.{t}").alias("table_name"), "rows", F.lit(len(star.raw[t].columns)).cast("bigint").alias("columns"))
        for t in tables])


def _is_text(dt) -> bool:
    return isinstance(dt, T.StringType)


def digest(c: Column) -> Column:
    """128 bits of a value: two 64-bit hashes with different seeds (NULL stays NULL)."""
    return F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(77), c).alias("h2")))


def distinct_counts(df: DataFrame, by: dict[str, Column] | None = None) -> DataFrame:
    """(column_name, by..., distinct_values): exact, of all columns in one pass.

    Rows are turned into (column, digest), counted in two phases (distinct digests, then their
    number): values themselves, however long, aren't shuffled, and repeats collapse before the shuffle.
    """
    groups = by or {}
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), digest(f(c)).alias("d")) for c in df.columns])
    long = df.select(*[c.alias(n) for n, c in groups.items()], F.explode(cells).alias("x")).select(*groups, "x.*").where(f("d").isNotNull())
    return long.select("column_name", *groups, "d.h1", "d.h2").distinct().groupBy("column_name", *groups).agg(F.count(F.lit(1)).cast("bigint").alias("distinct_values"))


def column_profile(df: DataFrame, table: str, keys, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Q2: per column type, nulls, null share, distinct, first example (in key order), min, max.

    One aggregation pass for all but the distinct counts, which are exact by ``distinct_counts`` or,
    with ``exact=False``, HyperLogLog++ estimates (relative error ``rsd``) of the same pass.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, fld in enumerate(df.schema.fields):
        c = f(fld.name)
        order = F.struct(*[f(k) for k in keys], c.cast("string"))
        estimate = F.lit(None) if exact else F.approx_count_distinct(c, rsd)
        aggs += [F.count_if(c.isNull()).cast("bigint").alias(f"n{i}"), estimate.cast("bigint").alias(f"d{i}"),
                 F.min_by(c.cast("string"), F.when(c.isNotNull(), order)).alias(f"e{i}")]
        if _is_text(fld.dataType):
            aggs += [F.lit(None).cast("string").alias(f"lo{i}"), F.lit(None).cast("string").alias(f"hi{i}")]
        else:
            aggs += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
    one = df.agg(*aggs)
    parts = ", ".join(f"'{fld.name}', '{fld.dataType.simpleString()}', n{i}, d{i}, e{i}, lo{i}, hi{i}"
                      for i, fld in enumerate(df.schema.fields))
    x = one.selectExpr("_rows", f"stack({len(df.columns)}, {parts}) AS (column_name, data_type, nulls, estimate, "
                                "example, min_value, max_value)")
    if exact:  # a row per column on both sides
        x = x.join(distinct_counts(df), "column_name", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0).cast("bigint")))
    else:
        x = x.withColumnRenamed("estimate", "distinct_values")
    return x.select(F.lit(f"raw.{table}").alias("table_name"), "column_name", "data_type", "nulls",
                    ratio(f("nulls"), f("_rows")).alias("null_share"), "distinct_values", "example", "min_value",
                    "max_value")


def column_profiles(star: Star, tables=PROFILED, exact: bool = True) -> DataFrame:
    return _union([column_profile(star.raw[t], t, C.RAW_KEYS[t], exact) for t in tables])


def key_candidates(star: Star, candidates=C.KEY_CANDIDATES) -> DataFrame:
    """Q3: rows vs distinct key tuples (NULL tuples count as values, like DISTINCT), one grouping per candidate."""
    parts = []
    for t, key in candidates:
        one = star.raw[t].groupBy(*key).count().agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("rows"),
                                                    F.count(F.lit(1)).cast("bigint").alias("distinct_keys"))
        parts.append(one.select(F.lit(f"raw.{t}").alias("table_name"), F.lit(", ".join(key)).alias("key_columns"),
                                "rows", "distinct_keys", (f("rows") == f("distinct_keys")).alias("is_unique")))
    return _union(parts)


def fk_profile(star: Star, relations=C.RELATIONSHIPS) -> DataFrame:
    """Q4: orphan keys (child side), childless parents, max children per key; one full join of keys per relation."""
    parts = []
    for child, fk, parent, pk in relations:
        c = star.raw[child].groupBy(f(fk).alias("k")).agg(F.count(F.lit(1)).alias("children")).filter(f("k").isNotNull())
        p = star.raw[parent].select(f(pk).alias("k")).distinct().withColumn("in_parent", F.lit(True))
        both = c.join(p, "k", "full_outer")
        parts.append(both.agg(count_if(f("in_parent").isNull()).alias("orphan_keys"), count_if(f("children").isNull()).alias("childless_parents"),
                              F.max("children").cast("bigint").alias("max_children"))
                     .select(F.lit(f"{child}.{fk}").alias("child"), F.lit(f"{parent}.{pk}").alias("parent"),
                             "orphan_keys", "childless_parents", "max_children"))
    return _union(parts)


def all_missing(columns) -> Column:
    """Every one of the columns is NULL."""
    return reduce(lambda x, y: x & y, [f(c).isNull() for c in columns])


def outside_box(box: dict[str, tuple]) -> Column:
    """Some column lies outside its range."""
    return reduce(lambda x, y: x | y, [~f(c).between(lo, hi) for c, (lo, hi) in box.items()])


def trap_checks(star: Star) -> DataFrame:
    """Q5 + Q6: check suite (check_id, label, value); one aggregate for each relation and grouping key.

    Document texts are compared by digest, comments reach the reviews as flags.
    """
    r = star.raw
    shipped, arrived = f("order_status").isin(*C.DELIVERED_STATUSES), f("order_delivered_customer_date").isNotNull()
    n = f("n")

    def grouped(df, key, **parts):
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in parts.items()])
    reviews = reviews_with_digests(star)
    low = f("review_score") <= C.LOW_SCORE_MAX
    bare = f("review_comment_title").isNull() & ~F.coalesce(f("blank") | f("words"), F.lit(False))
    texts = star.tables.documents.select(F.coalesce(F.md5("text"), F.lit("")).alias("digest"))
    categories = grouped(r["products"], "product_category_name", light=count_if(f("product_weight_g") == 0)).join(
        r["category_translation"].select("product_category_name", F.lit(True).alias("known")), "product_category_name", "left")
    named = f("product_category_name").isNotNull()
    lists = [
        (grouped(r["customers"], "customer_unique_id"), {1: F.sum(n), 2: count_if(f("customer_unique_id").isNotNull()), 3: count_if(n > 1)}),
        (r["orders"], {4: count_if(shipped), 5: count_if(shipped & ~arrived), 6: count_if(~shipped & arrived)}),
        (grouped(r["order_items"], "order_id", several=varies("seller_id"), late=count_if(f("shipping_limit_date") > F.lit(C.LATE_LIMIT_TS).cast("timestamp_ntz"))),
         {7: count_if(n > 1), 8: count_if(f("several")), 9: F.sum("late")}),
        (r["order_payments"], {10: count_if(f("payment_installments") == 0), 11: count_if(f("payment_value") == 0)}),
        (grouped(reviews, "review_id", several=varies("order_id"), words=count_if(f("words")), low=count_if(low), both=count_if(low & f("words")), bare=count_if(bare)),
         {12: count_if(n > 1), 13: count_if(f("several")), 15: F.sum("words"), 16: F.sum("low"), 17: F.sum("both"), 19: F.sum("bare")}),
        (grouped(r["order_reviews_keyed"], "order_id"), {14: count_if(n > 1)}),
        (categories, {18: F.sum(F.when(~named, n)), 20: F.sum("light"), 21: count_if(named & f("known").isNull())}),
        (grouped(texts, "digest"), {22: F.sum(n), 23: F.sum(n - 1)}),
        (grouped(r["geolocation"], "geolocation_zip_code_prefix", several=varies("geolocation_state")),
         {24: count_if(f("geolocation_zip_code_prefix").isNotNull()), 25: count_if(f("several"))}),
        (star.tables.customer, {26: count_if(outside_box(C.PLAUSIBLE_BOX))}),
    ]
    labels = dict(enumerate(C.TRAP_LABELS, 1))
    return _union([totals(df, checks, labels) for df, checks in lists]).withColumn("check_id", f("check_id").cast("bigint"))


def status_breakdown(star: Star) -> DataFrame:
    """Q7."""
    return star.raw["orders"].groupBy("order_status").agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"),
        F.count("order_delivered_customer_date").cast("bigint").alias("with_customer_delivery_date"))


def orders_without_items(star: Star) -> DataFrame:
    """Q8."""
    return (star.raw["orders"].join(star.raw["order_items"].select("order_id"), "order_id", "left_anti")
            .groupBy("order_status").agg(F.count(F.lit(1)).cast("bigint").alias("orders")))


def payment_types(star: Star) -> DataFrame:
    """Q9."""
    return star.raw["order_payments"].groupBy("payment_type").agg(F.count(F.lit(1)).cast("bigint").alias("payment_rows"))


def untranslated_categories(star: Star) -> DataFrame:
    """Q10."""
    return (star.raw["products"].filter(f("product_category_name").isNotNull()).select("product_category_name")
            .distinct().join(star.raw["category_translation"], "product_category_name", "left_anti"))


def score_by_comment(star: Star) -> DataFrame:
    """Q11."""
    text = unicode_trim(f("review_comment_message")) != ""
    return star.raw["order_reviews"].groupBy("review_score").agg(
        F.count(F.lit(1)).cast("bigint").alias("reviews"), count_if(text).alias("with_comment_message"))


def month_completeness(star: Star) -> DataFrame:
    """Q12."""
    o = star.raw["orders"]
    return o.groupBy(F.date_format("order_purchase_timestamp", "yyyy-MM").alias("purchase_month")).agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"),
        count_if(f("order_status").isin(*C.DELIVERED_STATUSES)).alias("delivered_orders"))
