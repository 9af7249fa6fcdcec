"""Binding + star schema as DuckDB CTEs, written independently of the Spark plans."""

from __future__ import annotations

from shipshape import config as C

P0, P1 = C.PERIOD_START, C.PERIOD_END
DELIV = ", ".join(f"'{s}'" for s in C.DELIVERED_STATUSES)
(M1, A1), (M2, A2) = C.PAYMENT_SURCHARGES
PTYPES = ", ".join(f"'{s}'" for s in C.PAYMENT_TYPES)
UNTRANSLATED = ", ".join(f"'{k}'" for k in C.UNTRANSLATED_BRANDS)

CTES: dict[str, str] = {}

CTES["ship_agg"] = """
    SELECT l_orderkey AS order_id, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_orderkey"""

CTES["raw_orders"] = f"""
    SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, o.o_orderstatus AS order_status,
           o.o_orderdate AS order_purchase_timestamp,
           CASE WHEN o.o_orderstatus <> 'P' THEN o.o_orderdate END AS order_approved_at,
           CAST(CAST(o.o_orderdate AS DATE) + CAST((((date_diff('day', CAST(o.o_orderdate AS DATE), CAST(s.first_ship AS DATE)) % {C.HANDOVER_SPREAD_DAYS}) + {C.HANDOVER_SPREAD_DAYS}) % {C.HANDOVER_SPREAD_DAYS}) AS INTEGER) AS TIMESTAMP) AS order_delivered_carrier_date,
           CAST(CAST(o.o_orderdate AS DATE) + CAST((((date_diff('day', CAST(o.o_orderdate AS DATE), CAST(s.last_ship AS DATE)) % {C.DELIVERY_SPREAD_DAYS}) + {C.DELIVERY_SPREAD_DAYS}) % {C.DELIVERY_SPREAD_DAYS}) AS INTEGER) AS TIMESTAMP) AS order_delivered_customer_date,
           CAST(CAST(o.o_orderdate AS DATE) + CAST({C.PROMISE_BASE_DAYS} + {C.PROMISE_STEP_DAYS} * CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS TIMESTAMP) AS order_estimated_delivery_date
    FROM orders o LEFT JOIN ship_agg s ON s.order_id = o.o_orderkey"""

CTES["raw_order_items"] = f"""
    SELECT l.l_orderkey AS order_id, CAST(l.l_linenumber AS BIGINT) AS order_item_id, l.l_partkey AS product_id,
           l.l_suppkey AS seller_id,
           CAST(CAST(o.o_orderdate AS DATE) + CAST({C.SHIP_LIMIT_BASE_DAYS} + l.l_linenumber AS INTEGER) AS TIMESTAMP) AS shipping_limit_date,
           CAST(l.l_extendedprice AS DECIMAL(12,2)) AS price,
           CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS freight_value
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey"""

CTES["raw_order_payments"] = f"""
    SELECT order_id, CAST(1 AS BIGINT) AS payment_sequential,
           CASE WHEN order_id % {C.PAYMENT_UNDEFINED_MOD} = 0 THEN 'not_defined'
                ELSE ([{PTYPES}])[CAST(order_id % {len(C.PAYMENT_TYPES)} + 1 AS INTEGER)] END AS payment_type,
           CAST(order_id % {C.PAYMENT_INSTALLMENT_MOD} AS BIGINT) AS payment_installments,
           CAST(items_total + CASE WHEN order_id % {M1} = 0 THEN {A1} ELSE 0 END AS DECIMAL(12,2)) AS payment_value
    FROM (SELECT l_orderkey AS order_id,
                 sum(CAST(l_extendedprice AS DECIMAL(12,2))
                     + CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2))) AS items_total
          FROM lineitem GROUP BY l_orderkey) t
    UNION ALL
    SELECT l_orderkey, CAST(2 AS BIGINT), 'voucher', CAST(1 AS BIGINT), CAST({A2} AS DECIMAL(12,2))
    FROM lineitem WHERE l_orderkey % {M2} = 0 GROUP BY l_orderkey"""

CTES["raw_order_reviews"] = f"""
    SELECT r.review_id, r.order_id, r.review_score, CAST(NULL AS VARCHAR) AS review_comment_title,
           d.text AS review_comment_message,
           CAST(CAST(o.o_orderdate AS DATE) + CAST(r.event_id % {C.SURVEY_SPREAD_DAYS} AS INTEGER) AS TIMESTAMP) AS review_creation_date,
           CAST(CAST(o.o_orderdate AS DATE) + CAST(r.event_id % {C.SURVEY_SPREAD_DAYS} AS INTEGER) AS TIMESTAMP)
               + (r.ts - date_trunc('day', r.ts)) AS review_answer_timestamp
    FROM (SELECT CAST(floor(event_id / 2) AS BIGINT) AS review_id,
                 CASE WHEN event_id % {C.REVIEW_SHIFT_EVERY} = 0 THEN event_id + 1 ELSE event_id END AS order_id,
                 CAST(floor(value) AS BIGINT) % 5 + 1 AS review_score, event_id, ts
          FROM events) r
    LEFT JOIN orders o ON o.o_orderkey = r.order_id
    LEFT JOIN documents d
      ON r.order_id % {C.COMMENT_MOD} < {C.COMMENT_BELOW} AND d.doc_id = CAST(floor(r.order_id / {C.COMMENT_DOC_STRIDE}) AS BIGINT)"""

CTES["raw_customers"] = """
    SELECT c.c_custkey AS customer_id, c.c_custkey AS customer_unique_id,
           lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
           c.c_mktsegment AS customer_city, n.n_name AS customer_state
    FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"""

CTES["raw_sellers"] = """
    SELECT s.s_suppkey AS seller_id, s.s_name AS seller_name,
           lpad(CAST(s.s_nationkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
           CAST(NULL AS VARCHAR) AS seller_city, n.n_name AS seller_state
    FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey"""

CTES["raw_products"] = f"""
    SELECT p_partkey AS product_id,
           CASE WHEN p_brand <> '{C.BRAND_WITHOUT_CATEGORY}' THEN p_brand END AS product_category_name,
           CAST(p_size AS BIGINT) AS product_weight_g
    FROM part"""

CTES["raw_category_translation"] = f"""
    SELECT DISTINCT p_brand AS product_category_name,
           'brand_' || lpad(substr(p_brand, 7, 10), 2, '0') AS product_category_name_english
    FROM part WHERE p_brand <> '{C.BRAND_WITHOUT_CATEGORY}' AND p_brand NOT IN ({UNTRANSLATED})"""

CTES["dim_geography"] = """
    SELECT n.n_name AS state_code, n.n_name AS state_name, r.r_name AS region
    FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey"""

def days(start: str, end: str, only: str = "TRUE") -> str:
    """Calendar days from one point to another, where ``only`` holds."""
    return f"CASE WHEN {only} THEN {end}::DATE - {start}::DATE END"


def values(rows) -> str:
    def cell(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


# the rules of the fields are data: bands of delay, and places of labels
FAR = 1_000_000
CTES["delay_rules"] = "SELECT * FROM (" + values(
    (label, -FAR if low is None else low, FAR if high is None else high, C.OUTCOMES[0] if low is None else C.OUTCOMES[1]) for label, low, high in C.DELAY_RULES) \
    + ") AS r (band, from_day, to_day, outcome)"
CTES["outcome_places"] = "SELECT * FROM (" + values((o, i) for i, o in enumerate(C.OUTCOMES, 1)) + ") AS p (outcome, place)"
CTES["band_places"] = "SELECT * FROM (" + values((o, i) for i, o in enumerate(C.DELAY_BANDS, 1)) + ") AS p (band, place)"

_T = {"bought": "order_purchase_timestamp", "handed": "order_delivered_carrier_date", "arrived": "order_delivered_customer_date",
      "promised": "order_estimated_delivery_date"}
CTES["stg_orders"] = f"""
    SELECT order_id, customer_unique_id, customer_state, order_status, order_approved_at, {", ".join(list(_T.values())[:3])},
           {_T["bought"]}::DATE AS purchase_date, {_T["handed"]}::DATE AS carrier_date,
           {_T["arrived"]}::DATE AS delivered_date, {_T["promised"]}::DATE AS estimated_date,
           {_T["arrived"]} IS NOT NULL AND order_status IN ({DELIV}) AS is_delivered,
           {days(_T["bought"], _T["promised"])} AS promised_days,
           {days(_T["bought"], _T["arrived"], "is_delivered")} AS delivery_days,
           {days(_T["promised"], _T["arrived"], "is_delivered")} AS delay_days,
           {days(_T["bought"], _T["handed"], f"{_T['bought']} <= {_T['handed']}")} AS handling_days,
           {days(_T["handed"], _T["arrived"], f"is_delivered AND {_T['handed']} <= {_T['arrived']}")} AS transit_days
    FROM raw_customers JOIN raw_orders USING (customer_id)
    WHERE {_T["bought"]}::DATE BETWEEN DATE '{P0}' AND DATE '{P1}' - 1"""

CTES["last_reviews"] = """
    SELECT DISTINCT ON (order_id) * FROM raw_order_reviews
    ORDER BY order_id, review_answer_timestamp DESC NULLS LAST, review_id DESC NULLS LAST"""

CTES["stg_reviews"] = """
    SELECT order_id, review_id, review_score, review_creation_date::DATE AS survey_sent_date, review_answer_timestamp,
           CASE WHEN trim(review_comment_message) <> '' THEN trim(review_comment_message) END AS review_comment_message
    FROM last_reviews WHERE order_id IN (SELECT order_id FROM stg_orders)"""

CTES["stg_order_items"] = """
    SELECT order_id, order_item_id, product_id, seller_id, seller_state, shipping_limit_date, price, freight_value
    FROM raw_order_items JOIN raw_sellers USING (seller_id) SEMI JOIN stg_orders USING (order_id)"""

CTES["dim_date"] = f"""
    WITH placed AS (
        SELECT date_trunc('month', min(o_orderdate)) AS low, last_day(max(o_orderdate)) AS high FROM orders
        WHERE o_orderdate::DATE BETWEEN DATE '{P0}' AND DATE '{P1}' - 1),
    days AS (SELECT unnest(generate_series(low, high, INTERVAL 1 DAY))::DATE AS date_day FROM placed)
    SELECT date_day, date_day - (day(date_day) - 1)::INT AS month_start, year(date_day) AS year, quarter(date_day) AS quarter,
           month(date_day) AS month_number, isodow(date_day) AS weekday_number, isodow(date_day) IN (6, 7) AS is_weekend,
           left(monthname(date_day), 3) AS month_name, left(dayname(date_day), 3) AS weekday_name,
           year(date_day) || '-' || lpad(month(date_day)::VARCHAR, 2, '0') AS year_month
    FROM days"""

CTES["category_names"] = f"""
    SELECT product_category_name AS pt, product_category_name_english AS en FROM raw_category_translation
    UNION ALL SELECT * FROM ({values(C.UNTRANSLATED_BRANDS.items())})"""

CTES["dim_product"] = """
    SELECT product_id, ifnull(product_category_name, 'unknown') AS category_pt,
           if(product_category_name IS NULL, 'unknown', (SELECT min(en) FROM category_names WHERE pt = product_category_name)) AS category_en
    FROM raw_products"""

CTES["dim_seller"] = f"""
    SELECT seller_id, seller_name[-{C.SELLER_SHORT_CHARS}:] AS seller_short, seller_city, seller_state,
           (SELECT min(region) FROM dim_geography WHERE state_code = seller_state) AS seller_region
    FROM raw_sellers"""

CTES["dim_customer"] = """
    SELECT customer_unique_id, count(*) AS order_count, len(list_distinct(list(purchase_date)))::BIGINT AS purchase_day_count,
           min(purchase_date) AS first_purchase_date, min(purchase_date) < max(purchase_date) AS is_repeat_customer,
           arg_min(customer_state, (order_purchase_timestamp, order_id)) AS first_order_state
    FROM stg_orders GROUP BY ALL"""

CTES["item_agg"] = """
    SELECT order_id, count(*) AS item_count, len(list_distinct(list(seller_id)))::BIGINT AS seller_count,
           max(shipping_limit_date) AS last_shipping_limit, sum(price)::DECIMAL(12,2) AS items_value,
           sum(freight_value)::DECIMAL(12,2) AS freight_value, min((seller_state = customer_state)::INT) = 1 AS is_same_state
    FROM stg_order_items JOIN (SELECT order_id, customer_state FROM stg_orders) USING (order_id) GROUP BY order_id"""

# labels of an order: its rule if it was delivered, else by its status
CTES["order_labels"] = f"""
    SELECT s.order_id, coalesce(r.outcome, l.label) AS outcome, coalesce(r.band, l.label) AS band
    FROM (SELECT *, if(order_status IN ({DELIV}), 'Unknown', 'Not delivered') AS label FROM stg_orders) l
    JOIN stg_orders s USING (order_id) LEFT JOIN delay_rules r ON s.is_delivered AND s.delay_days BETWEEN r.from_day AND r.to_day"""

CTES["history"] = """
    SELECT order_id, row_number() OVER person AS customer_order_number FROM stg_orders
    WINDOW person AS (PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp, order_id)"""

CTES["fact_orders"] = f"""
    SELECT order_id, s.customer_unique_id, s.customer_state, s.purchase_date, s.order_status, s.is_delivered,
           s.promised_days, s.delivery_days, s.delay_days, s.handling_days, s.transit_days, customer_order_number,
           l.outcome AS delivery_outcome, op.place::BIGINT AS delivery_outcome_sort, l.band AS delay_band, bp.place::BIGINT AS delay_band_sort,
           if(s.is_delivered, l.outcome = 'On time', NULL) AS is_on_time,
           s.order_delivered_carrier_date > i.last_shipping_limit AS is_seller_handover_late,
           i.item_count IS NOT NULL AS has_items, i.item_count, i.seller_count, i.items_value, i.freight_value, i.is_same_state,
           (i.items_value + i.freight_value)::DECIMAL(12,2) AS order_total,
           ['No items', 'Single item', 'Several items'][1 + least(coalesce(i.item_count, 0), 2)] AS order_size,
           r.review_id IS NOT NULL AS has_review, r.review_score, r.review_score < {C.LOW_SCORE_MAX + 1} AS is_low_score,
           r.review_comment_message IS NOT NULL AS has_comment,
           if(s.is_delivered AND r.review_id IS NOT NULL, r.review_answer_timestamp < s.order_delivered_customer_date, NULL) AS review_before_delivery
    FROM stg_orders s JOIN order_labels l USING (order_id) JOIN history USING (order_id)
    JOIN outcome_places op ON op.outcome = l.outcome JOIN band_places bp ON bp.band = l.band
    LEFT JOIN item_agg i USING (order_id) LEFT JOIN stg_reviews r USING (order_id)"""

CTES["fact_order_items"] = """
    SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, i.price, i.freight_value, of_order.* EXCLUDE (order_id, carrier, sellers),
           i.seller_state = of_order.customer_state AS is_same_state, of_order.carrier > i.shipping_limit_date AS is_seller_handover_late,
           of_order.sellers > 1 AS is_multi_seller_order
    FROM stg_order_items i JOIN (
        SELECT order_id, purchase_date, customer_state, delivery_outcome, is_delivered, is_on_time, delay_days, has_review, review_score,
               is_low_score, seller_count AS sellers, order_delivered_carrier_date AS carrier
        FROM fact_orders JOIN (SELECT order_id, order_delivered_carrier_date FROM stg_orders) USING (order_id)) of_order USING (order_id)"""


def with_star(select_sql: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <binding + star CTEs> [, extra CTEs] <select_sql>``."""
    ctes = dict(CTES)
    ctes.update(extra or {})
    body = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in ctes.items())
    head = select_sql.lstrip()
    if head[:5].upper() == "WITH ":                 # merge the query's own CTEs into the chain
        return f"WITH {body},\n{head[5:]}"
    return f"WITH {body}\n{select_sql}"
