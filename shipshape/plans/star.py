"""Staging, dimensions and facts of the star schema.

Grain rules: ``fact_orders`` one row per in-period order, ``fact_order_items`` one row per unit
sold; items are aggregated to the order grain *before* they are joined to orders, and the order
outcome is copied onto items so no fact-to-fact join is ever needed.

Physical shape: every order-grain step (ship window, item aggregation, latest review, fact join)
is keyed by ``order_id``, so Spark hash-partitions lineitem, orders and reviews once on that key
and reuses the partitioning, in later steps too, as the written tables are bucketed by it; dimension tables are small and broadcast by AQE when their runtime
size is under the broadcast threshold; the per-person order number uses the skew-safe
range-partitioned numbering of :mod:`shipshape.operators.rank`.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from shipshape import config as C
from shipshape.functions.exprs import band, blank_to_null, days_between, guarded_days, has_text, label_sort, null_splitting_left_join
from shipshape.operators.rank import sequence_in_group
from shipshape.sources import binding
from shipshape.sources.tables import Tables


def in_period(ts_col: str, start: str = C.PERIOD_START, end: str = C.PERIOD_END):
    return (F.col(ts_col) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts_col) < F.lit(end).cast("timestamp_ntz"))


def with_person(orders: DataFrame, raw_customers: DataFrame) -> DataFrame:
    """Orders of known customers with the person and the state."""
    return orders.join(raw_customers.select("customer_id", "customer_unique_id", "customer_state"), "customer_id", "inner")


def stg_orders(raw_orders: DataFrame, raw_customers: DataFrame | None, start: str = C.PERIOD_START,
               end: str = C.PERIOD_END, delivered_statuses=C.DELIVERED_STATUSES) -> DataFrame:
    """B1: in-period orders with the person, dates, delivered flag and five guarded durations.

    Without ``raw_customers`` the orders come :func:`with_person` already.
    """
    o = raw_orders.filter(in_period("order_purchase_timestamp", start, end))
    base = (o if raw_customers is None else with_person(o, raw_customers)).select(
        "order_id", "customer_unique_id", "customer_state", "order_status", "order_purchase_timestamp",
        "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
        F.to_date("order_purchase_timestamp").alias("purchase_date"),
        F.to_date("order_delivered_carrier_date").alias("carrier_date"),
        F.to_date("order_delivered_customer_date").alias("delivered_date"),
        F.to_date("order_estimated_delivery_date").alias("estimated_date"),
        (F.col("order_status").isin(*delivered_statuses)
         & F.col("order_delivered_customer_date").isNotNull()).alias("is_delivered"))
    d = F.col("is_delivered")
    return base.select(
        "*",
        days_between(F.col("purchase_date"), F.col("estimated_date")).alias("promised_days"),
        F.when(d, days_between(F.col("purchase_date"), F.col("delivered_date"))).alias("delivery_days"),
        F.when(d, days_between(F.col("estimated_date"), F.col("delivered_date"))).alias("delay_days"),
        guarded_days(F.col("order_purchase_timestamp"), F.col("order_delivered_carrier_date"),
                     F.col("purchase_date"), F.col("carrier_date")).alias("handling_days"),
        guarded_days(F.col("order_delivered_carrier_date"), F.col("order_delivered_customer_date"),
                     F.col("carrier_date"), F.col("delivered_date"), extra=d).alias("transit_days"))


def latest_review_per_order(reviews: DataFrame, keep: list[str]) -> DataFrame:
    """The most recently answered review per order (tie-break review_id desc).

    Written as ``max_by`` so it is a partial (map-side) aggregation: an order with very many
    reviews never ends up as one sorted group in one task.
    """
    rank_key = F.struct(F.col("review_answer_timestamp"), F.col("review_id"))
    picked = F.max_by(F.struct(*[F.col(c) for c in keep]), rank_key).alias("_r")
    return reviews.groupBy("order_id").agg(picked).select("order_id", *[F.col(f"_r.{c}").alias(c) for c in keep])


def stg_reviews(raw_reviews_keyed: DataFrame, orders: DataFrame, flags: DataFrame) -> DataFrame:
    """B2: one review per in-period order; ``has_comment`` = comment present after trimming.

    The dedupe carries the comment's document key, not its text; the text is attached afterwards
    only by :func:`stg_reviews_text`.
    """
    r = raw_reviews_keyed.join(orders.select("order_id"), "order_id", "left_semi")
    r = r.select("order_id", "review_id", "review_score", "comment_doc_id",
                 F.to_date("review_creation_date").alias("survey_sent_date"), "review_answer_timestamp")
    latest = latest_review_per_order(r, ["review_id", "review_score", "comment_doc_id", "survey_sent_date",
                                         "review_answer_timestamp"])
    # three fifths of the reviews have no comment: their NULL keys go round the join
    return (null_splitting_left_join(latest, flags, "comment_doc_id")
            .withColumn("has_comment", F.coalesce(F.col("comment_present"), F.lit(False))).drop("comment_present"))


def stg_reviews_text(reviews: DataFrame, t: Tables) -> DataFrame:
    """stg.reviews with the cleaned comment text."""
    x = binding.attach_comment(reviews, t, clean=blank_to_null)
    return x.select("order_id", "review_id", "review_score", "review_comment_message", "survey_sent_date",
                    "review_answer_timestamp")


def stg_order_items(raw_items: DataFrame, orders: DataFrame, raw_sellers: DataFrame) -> DataFrame:
    """Items of in-period orders with the seller's state."""
    sellers = raw_sellers.select("seller_id", "seller_state")
    return (raw_items.join(orders.select("order_id"), "order_id", "left_semi")
            .join(sellers, "seller_id", "inner")
            .select("order_id", "order_item_id", "product_id", "seller_id", "seller_state",
                    "shipping_limit_date", "price", "freight_value"))


def dim_date(placed: DataFrame, ts_col: str = "o_orderdate") -> DataFrame:
    """One row per calendar day of the months from the first to the last purchase in the period."""
    ends = placed.filter(in_period(ts_col)).agg(F.trunc(F.min(ts_col), "MM").alias("a"), F.last_day(F.max(ts_col)).alias("b"))
    days = ends.filter(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("d"))
    d = F.col("d")
    iso = (F.weekday(d) + 1).cast("bigint")
    return days.select(
        d.alias("date_day"), F.year(d).cast("bigint").alias("year"), F.quarter(d).cast("bigint").alias("quarter"),
        F.month(d).cast("bigint").alias("month_number"), F.date_format(d, "MMM").alias("month_name"),
        F.date_format(d, "yyyy-MM").alias("year_month"), F.trunc(d, "MM").alias("month_start"),
        iso.alias("weekday_number"), F.date_format(d, "EEE").alias("weekday_name"), (iso >= 6).alias("is_weekend"))


def dim_geography(geo: DataFrame) -> DataFrame:
    """One row per state with its region."""
    return geo.select("state_code", "state_name", "region")


def dim_product(raw_products: DataFrame, translation: DataFrame,
                manual: dict[str, str] = C.UNTRANSLATED_BRANDS) -> DataFrame:
    """Category with 'unknown' for missing, translation, and hand translations."""
    p = raw_products.join(translation, "product_category_name", "left")
    name = F.col("product_category_name")
    en = F.when(name.isNull(), F.lit("unknown")).when(
        F.col("product_category_name_english").isNotNull(), F.col("product_category_name_english"))
    for k, v in manual.items():
        en = en.when(name == k, F.lit(v))
    return p.select("product_id", F.coalesce(name, F.lit("unknown")).alias("category_pt"), en.alias("category_en"))


def dim_seller(raw_sellers: DataFrame, geo: DataFrame, short_chars: int = C.SELLER_SHORT_CHARS) -> DataFrame:
    """Seller with a short label and its region."""
    g = geo.select(F.col("state_code").alias("seller_state"), F.col("region").alias("seller_region"))
    return (raw_sellers.join(g, "seller_state", "left")
            .select("seller_id", F.substring("seller_name", -short_chars, short_chars).alias("seller_short"),
                    "seller_city", "seller_state", "seller_region"))


def dim_customer(orders: DataFrame) -> DataFrame:
    """One row per person; first order by (timestamp, order id) via min_by (no window)."""
    first = F.struct(F.col("order_purchase_timestamp"), F.col("order_id"))
    days = F.count_distinct("purchase_date")
    return orders.groupBy("customer_unique_id").agg(
        F.min("purchase_date").alias("first_purchase_date"),
        F.min_by("customer_state", first).alias("first_order_state"),
        F.count(F.lit(1)).cast("bigint").alias("order_count"),
        days.cast("bigint").alias("purchase_day_count"),
        (days > 1).alias("is_repeat_customer"))


def item_agg(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items collapsed to the order grain before any join to orders."""
    i = items.join(orders.select("order_id", "customer_state"), "order_id", "inner")
    return i.groupBy("order_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("item_count"),
        F.count_distinct("seller_id").cast("bigint").alias("seller_count"),
        F.sum("price").cast("decimal(12,2)").alias("items_value"),
        F.sum("freight_value").cast("decimal(12,2)").alias("freight_value"),
        F.max("shipping_limit_date").alias("last_shipping_limit"),
        F.bool_and(F.col("seller_state") == F.col("customer_state")).alias("is_same_state"))


def _outcome_cols():
    """Outcome and delay band with the places of both in ``config.OUTCOMES`` and ``config.DELAY_BANDS``."""
    d, delay = F.col("is_delivered"), F.col("delay_days")
    open_ = F.when(F.col("order_status").isin(*C.DELIVERED_STATUSES), C.OUTCOMES[3]).otherwise(C.OUTCOMES[2])
    outcome = F.when(d, F.when(delay <= 0, C.OUTCOMES[0]).when(delay > 0, C.OUTCOMES[1])).otherwise(open_)
    banded = F.when(d, band(delay, [(low, high, label) for label, low, high in C.DELAY_RULES])).otherwise(open_)
    return outcome, label_sort(outcome, C.OUTCOMES), banded, label_sort(banded, C.DELAY_BANDS)


FACT_ORDER_COLUMNS = [
    "order_id", "customer_unique_id", "purchase_date", "customer_state", "order_status", "delivery_outcome",
    "delivery_outcome_sort", "delay_band", "delay_band_sort", "is_delivered", "is_on_time", "promised_days",
    "delivery_days", "delay_days", "handling_days", "transit_days", "is_seller_handover_late", "has_items",
    "item_count", "order_size", "seller_count", "items_value", "freight_value", "order_total", "is_same_state",
    "has_review", "review_score", "is_low_score", "has_comment", "review_before_delivery", "customer_order_number",
]


def fact_orders(orders: DataFrame, agg: DataFrame, reviews: DataFrame, numbered: bool = True,
                low_max: int = C.LOW_SCORE_MAX) -> DataFrame:
    """One row per order; outcome labels, flags (NULL when not measurable), value, review."""
    a = agg.withColumn("_has_items", F.lit(True))
    r = reviews.select("order_id", "review_score", F.col("has_comment").alias("_has_comment"),
                       "review_answer_timestamp", F.lit(True).alias("_has_review"))
    x = orders.join(a, "order_id", "left").join(r, "order_id", "left")
    outcome, outcome_sort, band, band_sort = _outcome_cols()
    d = F.col("is_delivered")
    has_items = F.coalesce(F.col("_has_items"), F.lit(False))
    has_review = F.coalesce(F.col("_has_review"), F.lit(False))
    n = F.col("item_count")
    out = x.select(
        "order_id", "customer_unique_id", "purchase_date", "customer_state", "order_status",
        outcome.alias("delivery_outcome"), outcome_sort.alias("delivery_outcome_sort"),
        band.alias("delay_band"), band_sort.alias("delay_band_sort"), "is_delivered",
        F.when(d, F.col("delay_days") <= 0).alias("is_on_time"),
        "promised_days", "delivery_days", "delay_days", "handling_days", "transit_days",
        F.when(F.col("order_delivered_carrier_date").isNotNull() & F.col("last_shipping_limit").isNotNull(),
               F.col("order_delivered_carrier_date") > F.col("last_shipping_limit")).alias("is_seller_handover_late"),
        has_items.alias("has_items"), "item_count",
        F.when(n >= 2, "Several items").when(n == 1, "Single item").otherwise("No items").alias("order_size"),
        "seller_count", "items_value", "freight_value",
        (F.col("items_value") + F.col("freight_value")).cast("decimal(12,2)").alias("order_total"),
        "is_same_state", has_review.alias("has_review"), "review_score",
        (F.col("review_score") <= low_max).alias("is_low_score"),
        F.coalesce(F.col("_has_comment"), F.lit(False)).alias("has_comment"),
        F.when(d & has_review, F.col("review_answer_timestamp") < F.col("order_delivered_customer_date"))
        .alias("review_before_delivery"),
        "order_purchase_timestamp")
    if numbered:
        out = sequence_in_group(out, ["customer_unique_id"], ["order_purchase_timestamp", "order_id"],
                                "customer_order_number")
    else:
        out = out.withColumn("customer_order_number", F.lit(None).cast("bigint"))
    return out.select(*FACT_ORDER_COLUMNS)


FACT_ITEM_COLUMNS = [
    "order_id", "order_item_id", "product_id", "seller_id", "purchase_date", "customer_state", "price",
    "freight_value", "is_same_state", "is_seller_handover_late", "is_multi_seller_order", "delivery_outcome",
    "is_delivered", "is_on_time", "delay_days", "has_review", "review_score", "is_low_score",
]


def fact_order_items(items: DataFrame, facts: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per unit sold with the order outcome copied on."""
    f = facts.select("order_id", "purchase_date", "customer_state", F.col("seller_count"), "delivery_outcome",
                     "is_delivered", "is_on_time", "delay_days", "has_review", "review_score", "is_low_score")
    o = orders.select("order_id", "order_delivered_carrier_date")
    x = items.join(f, "order_id", "inner").join(o, "order_id", "inner")
    carrier = F.col("order_delivered_carrier_date")
    return x.select(
        "order_id", "order_item_id", "product_id", "seller_id", "purchase_date", "customer_state", "price",
        "freight_value", (F.col("seller_state") == F.col("customer_state")).alias("is_same_state"),
        F.when(carrier.isNotNull(), carrier > F.col("shipping_limit_date")).alias("is_seller_handover_late"),
        (F.col("seller_count") > 1).alias("is_multi_seller_order"), "delivery_outcome", "is_delivered",
        "is_on_time", "delay_days", "has_review", "review_score", "is_low_score")


class LazyLayer(dict):
    """A layer of named DataFrames whose plans are built on first access (``builders``: name ->
    function of the layer). Assigned entries take precedence; ``copy`` keeps the builders."""

    def __init__(self, builders: dict, built: dict | None = None):
        super().__init__(built or {})
        self._builders = builders

    def __missing__(self, name: str) -> DataFrame:
        if name not in self._builders:
            raise KeyError(name)
        self[name] = self._builders[name](self)
        return dict.__getitem__(self, name)

    def __contains__(self, name) -> bool:
        return dict.__contains__(self, name) or name in self._builders

    def copy(self) -> "LazyLayer":
        return LazyLayer(self._builders, dict(self))


@dataclass
class Star:
    """All layers of one source folder, as lazy DataFrames (built once per session and folder)."""

    spark: SparkSession
    src: str
    tables: Tables
    raw: dict = field(default_factory=dict)
    stg: dict = field(default_factory=dict)
    model: dict = field(default_factory=dict)
    observed: dict = field(default_factory=dict)   # written table -> its observed metrics

    def __getitem__(self, name: str) -> DataFrame:
        for layer in (self.model, self.stg):
            if name in layer:
                return layer[name]
        return self.raw[name]

    def once(self, name: str, build) -> DataFrame:
        """A result that a query reads several times; a written star stores it."""
        return build()

    @property
    def buckets(self) -> int:
        """Buckets of the tables by order; 0 without."""
        return 0

    def by_order(self, name: str) -> DataFrame:
        """A table for steps by order: in ``buckets``, if there are any."""
        return self[name]


def tasks_by_order(t: Tables) -> int:
    """Tasks of a join by order, by the rows; the session's shuffle partitions, if not many more, as the
    planner deals a join of two exchanges to no fewer."""
    n, least = t.tasks("orders", "lineitem", "events"), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, least) if n >= least // 4 else n


def build_star(spark: SparkSession, src: str) -> Star:
    t = Tables(spark, src)
    raw = binding.raw_tables(t)
    geo = binding.geography(t)
    # the person is joined before the ship dates, on few columns; the wide rows then stay dealt by order
    placed = with_person(binding.placed_orders(t).filter(in_period("order_purchase_timestamp")), raw["customers"])
    so = stg_orders(binding.raw_orders(t, tasks_by_order(t), placed), None)
    sr = stg_reviews(raw["order_reviews_keyed"], so, binding.comment_flags(t, has_text))
    si = stg_order_items(raw["order_items"], so, raw["sellers"])
    model = LazyLayer({
        "dim_geography": lambda m: dim_geography(geo), "dim_date": lambda m: dim_date(t.orders),
        "dim_product": lambda m: dim_product(raw["products"], raw["category_translation"]),
        "dim_seller": lambda m: dim_seller(raw["sellers"], geo), "dim_customer": lambda m: dim_customer(so),
        "item_agg": lambda m: item_agg(si, so),
        "fact_orders": lambda m: fact_orders(so, m["item_agg"], sr, numbered=False),
        "fact_order_items": lambda m: fact_order_items(si, m["fact_orders"], so),
    })
    return Star(spark, src, tables=t, raw=raw,
                stg={"orders": so, "reviews": sr, "order_items": si, "geography": geo}, model=model)


def numbered_facts(star: "Star") -> DataFrame:
    """fact_orders with ``customer_order_number`` (skew-safe numbering per person)."""
    if "fact_orders_numbered" not in star.model:
        star.model["fact_orders_numbered"] = _number(star)
    return star.model["fact_orders_numbered"]


def order_numbers(orders: DataFrame) -> DataFrame:
    """order_id -> position in the person's history (by purchase time, then id), numbered on the
    narrow (order, person, time) projection only (skew-safe, see :mod:`shipshape.operators.rank`)."""
    narrow = orders.select("order_id", "customer_unique_id", "order_purchase_timestamp")
    numbered = sequence_in_group(narrow, ["customer_unique_id"], ["order_purchase_timestamp", "order_id"],
                                 "customer_order_number")
    return numbered.select("order_id", "customer_order_number")


def attach_numbers(facts: DataFrame, numbers: DataFrame) -> DataFrame:
    """fact_orders with ``customer_order_number`` (one key join on order_id)."""
    return facts.drop("customer_order_number").join(numbers, "order_id", "inner").select(*FACT_ORDER_COLUMNS)


def _number(star: "Star") -> DataFrame:
    return attach_numbers(star.model["fact_orders"], order_numbers(star.stg["orders"]))


def review_frame(star: "Star") -> DataFrame:
    """R1 sampling frame of a star: keys, flags and the comments' document keys, no texts."""
    if "_frame" not in star.model:
        from shipshape.operators.sampling import sample_frame
        star.model["_frame"] = sample_frame(star.stg["reviews"], star.model["fact_orders"], star.raw["order_reviews_keyed"])
    return star.model["_frame"]


class StarOnce:
    """A star whose staging, dimensions and facts are each written when a query first asks for them,
    and read by all later queries. Raw tables stay lazy: a profile of them builds nothing."""

    def __init__(self, lazy: Star):
        self.lazy = lazy
        self.spark, self.src, self.tables, self.raw = lazy.spark, lazy.src, lazy.tables, lazy.raw
        self._written: Star | None = None
        self._layers = None

    @property
    def written(self) -> Star:
        if self._written is None:
            self._written = materialize(self.lazy, (*VALIDATED, "frame"), when_asked=True)
        return self._written

    @property
    def layers(self):
        """The written tables and views of :mod:`shipshape.plans.layers`."""
        if self._layers is None:
            from shipshape.plans.layers import write_layers
            self._layers = write_layers(self.written)
        return self._layers

    stg = property(lambda self: self.written.stg)
    model = property(lambda self: self.written.model)

    @property
    def observed(self) -> dict:
        """The observed metrics of all tables that the reconciliation tests read (written now, if not yet)."""
        self.written.write(*VALIDATED)
        return self.written.observed

    def __getitem__(self, name: str) -> DataFrame:
        return self.written[name]

    def once(self, name: str, build) -> DataFrame:
        return self.written.once(name, build)


_CACHE: dict = {}


def star_for(spark: SparkSession, src: str) -> StarOnce:
    """Session-scoped memo: the star of a folder, as it was listed first, is written at most once."""
    key = (spark.sparkContext.applicationId, id(spark), src)
    if key not in _CACHE:
        _CACHE[key] = StarOnce(build_star(spark, src))
    return _CACHE[key]


@contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]):
    """Settings of the session for a while."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_removed(spark: SparkSession):
    """The shuffle files of a write go as soon as its table is written: nothing reads them again, and the
    driver, which would remove them when it collects garbage, may have no cause to for hours."""
    return session_conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def _persist_parquet(df: DataFrame, folder: str, name: str, metrics: dict, db: str = "", buckets: int = 0) -> tuple[DataFrame, dict | None]:
    """Write a table and read it back; ``metrics`` (name -> aggregate) are gathered by the same job.

    With ``buckets`` it is also a table of the namespace ``db``, whose place is the folder, with a sorted
    file for each bucket of orders: joins by order that ask for that table read it without an exchange.
    """
    path = f"{folder.rstrip('/')}/{name}"
    seen = Observation() if metrics else None
    if buckets:
        df = binding.dealt(df, buckets)
    if seen:
        df = df.observe(seen, *[c.alias(n) for n, c in metrics.items()])
    if buckets:
        df.write.mode("overwrite").bucketBy(buckets, "order_id").sortBy("order_id").format("parquet").saveAsTable(f"{db}.{name}")
    else:
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path), seen.get if seen else None


def _persist_level(jobs: dict[str, tuple[DataFrame, str, int]], folder: str, observed: dict, db: str) -> dict[str, DataFrame]:
    """Write independent tables as concurrent Spark jobs (one driver thread each); the scheduler
    interleaves their stages, so small stages of one table do not leave the cluster idle."""
    from concurrent.futures import ThreadPoolExecutor

    from shipshape.operators.validate import metrics
    if not jobs:
        return {}
    spark = next(iter(jobs.values()))[0].sparkSession
    if any(buckets for _, _, buckets in jobs.values()):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{folder}'")
    with shuffles_removed(spark), ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        futures = {k: pool.submit(_persist_parquet, df, folder, name, metrics(k), db, buckets) for k, (df, name, buckets) in jobs.items()}
        done = {k: fut.result() for k, fut in futures.items()}
    observed.update({k: seen for k, (_, seen) in done.items() if seen is not None})
    return {k: df for k, (df, _) in done.items()}


DIMENSIONS = ("dim_date", "dim_geography", "dim_product", "dim_seller")
#: The tables that the reconciliation tests read.
VALIDATED = ("orders", "reviews", "order_items", "fact_orders", "fact_order_items", "dim_customer", *DIMENSIONS)


#: The written tables that each table is built from.
NEEDS = {"reviews": ("orders",), "order_items": ("orders",), "fact_orders": ("orders", "order_items", "reviews"),
         "fact_order_items": ("orders", "order_items", "fact_orders"), "dim_customer": ("orders",), "order_numbers": ("orders",),
         "fact_orders_numbered": ("fact_orders", "order_numbers"), "_frame": ("reviews", "fact_orders")}
STAGING = ("orders", "reviews", "order_items")
#: Tables that the next ones join by order: dealt to buckets once, when they are written.
BY_ORDER = (*STAGING, "fact_orders", "fact_order_items")


def folder_of(name: str) -> str:
    return f"stg_{name}" if name in STAGING else name.lstrip("_")


@dataclass
class WrittenStar(Star):
    """A star whose tables ``names`` are written as Parquet when first asked for, after those they need."""

    names: tuple = ()
    folder: str = ""
    db: str = ""
    done: dict = field(default_factory=dict)
    lazy: Star | None = None

    def write(self, *names: str) -> None:
        """Write what is missing of these tables; tables that do not depend on each other at the same time."""
        missing, ask = {}, [n for n in names]
        while ask:
            n = ask.pop()
            if n in self.names and n not in self.done and n not in missing:
                missing[n] = [x for x in NEEDS.get(n, ()) if x in self.names]
            if n not in self.done:
                ask += NEEDS.get(n, ())
        while missing:
            ready = sorted(n for n, needs in missing.items() if all(x in self.done for x in needs))
            jobs = {n: (self.built(n), folder_of(n), self.buckets if n in BY_ORDER else 0) for n in ready}
            self.done.update(_persist_level(jobs, self.folder, self.observed, self.db))
            missing = {n: needs for n, needs in missing.items() if n not in ready}

    @property
    def buckets(self) -> int:
        """Buckets of the tables by order: as many as a join of them has tasks; 0 above what Spark allows."""
        n = tasks_by_order(self.tables)
        return n if n <= int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets")) else 0

    def table(self, name: str) -> DataFrame:
        if name not in self.names:
            return self.built(name)
        self.write(name)
        return self.done[name]

    def by_order(self, name: str) -> DataFrame:
        df = self.table(name)
        bucketed = name in BY_ORDER and name in self.names and self.buckets
        return self.spark.table(f"{self.db}.{folder_of(name)}") if bucketed else df

    def built(self, name: str) -> DataFrame:
        """The plan of a table over the written ones; joins by order are dealt by rows, which Spark
        leaves out for a table in as many buckets."""
        t, raw, of, n = self.tables, self.raw, self.table, tasks_by_order(self.tables)

        def by_order(x: str) -> DataFrame:
            return binding.merged(t, self.by_order(x), n)

        def raw_by_order(x: str) -> DataFrame:
            return raw.dealt(x, n) if isinstance(raw, binding.RawLayer) else raw[x]
        return {
            "reviews": lambda: stg_reviews(raw_by_order("order_reviews_keyed"), by_order("orders"), binding.comment_flags(t, has_text)),
            "order_items": lambda: stg_order_items(raw_by_order("order_items"), by_order("orders"), binding.sent_sellers(t, raw["sellers"])),
            "item_agg": lambda: item_agg(by_order("order_items"), by_order("orders")),
            "fact_orders": lambda: fact_orders(by_order("orders"), self.built("item_agg"), by_order("reviews"), numbered=False),
            "fact_order_items": lambda: fact_order_items(by_order("order_items"), by_order("fact_orders"), by_order("orders")),
            "dim_customer": lambda: dim_customer(of("orders")),
            "order_numbers": lambda: order_numbers(of("orders")),
            "fact_orders_numbered": lambda: attach_numbers(by_order("fact_orders"), by_order("order_numbers")),
            "_frame": lambda: review_frame(self.plain()),
        }.get(name, lambda: self.lazy[name])()

    def once(self, name: str, build) -> DataFrame:
        if name not in self.done:
            df = build()
            with shuffles_removed(self.spark):
                self.done[name] = _persist_parquet(df, self.folder, name, {})[0]
        return self.done[name]

    def plain(self) -> Star:
        """The star that the review frame is drawn from."""
        return Star(self.spark, self.src, tables=self.tables, raw=self.raw, stg={"reviews": self.table("reviews")},
                    model={"fact_orders": self.table("fact_orders")})


def materialize(star: Star, names=("orders", "reviews", "order_items", "fact_orders", "fact_order_items",
                                   "dim_customer", "frame"), numbered: bool = True, when_asked: bool = False) -> Star:
    """Cut lineage of the reused layers by writing them as Parquet tables into the cluster's shared
    checkpoint folder (``spark.checkpoint.dir``) and reading them back.

    One computation per table (a reliable RDD checkpoint would compute twice), the tables survive
    executor loss, and later queries get column pruning and filter pushdown on them. Tables that do
    not depend on each other are written concurrently, in levels (``NEEDS``). What the reconciliation
    tests need of a table is observed while it is written (``Star.observed``). ``when_asked``: each
    table is written when it is first asked for, with those it needs.
    """
    import uuid

    from shipshape.session import ensure_checkpoint_dir
    folder = f"{ensure_checkpoint_dir(star.spark).rstrip('/')}/star-{uuid.uuid4().hex}"
    wanted = [("_frame" if n == "frame" else n) for n in names]
    if numbered and "fact_orders" in names:
        wanted += ["order_numbers", "fact_orders_numbered"]
    out = WrittenStar(star.spark, star.src, tables=star.tables, raw=star.raw, names=tuple(wanted), folder=folder,
                      db=f"tables_{uuid.uuid4().hex}", lazy=star)

    def layer(given: dict, added: tuple) -> LazyLayer:
        builders = dict(given._builders) if isinstance(given, LazyLayer) else {n: (lambda _, n=n: given[n]) for n in given}
        return LazyLayer(builders | {n: (lambda _, n=n: out.table(n)) for n in added})
    out.stg = layer(dict(star.stg), tuple(n for n in STAGING if n in star.stg))
    own = [n for n in wanted if n not in STAGING and n != "order_numbers"]
    out.model = layer(star.model, (*own, "item_agg", *[n for n in ("fact_orders", "fact_order_items", "dim_customer") if n not in own]))
    if not when_asked:
        out.write(*wanted)
    return out
