"""Fixed values of the model and of its binding to the driver tables.

Every operator takes its thresholds as parameters; the defaults below are the ones the registered
queries use. The binding rules (how TPC-H-like tables become orders, items, payments, reviews,
customers, sellers and products) are documented in FIXTURES.md section 3.
"""

# --- fixed values: analysis period (half-open) and calendar --------------------------------------
PERIOD_START = "1996-01-01"
PERIOD_END = "2001-01-01"

# --- fixed values: binding of the driver tables ---------------------------------------------------
DELIVERED_STATUSES = ("F", "O")        # statuses that mean "delivered"; P = not delivered
DELIVERY_SPREAD_DAYS = 60              # delivered = purchase + pmod(last ship - purchase, 60)
HANDOVER_SPREAD_DAYS = 12              # handover  = purchase + pmod(first ship - purchase, 12)
PROMISE_BASE_DAYS = 21                 # promised  = purchase + 21 + 5 * priority digit
PROMISE_STEP_DAYS = 5
SHIP_LIMIT_BASE_DAYS = 3               # shipping limit = purchase + 3 + line number
REVIEW_SHIFT_EVERY = 5                 # event_id mod 5 = 0 reviews the next order
SURVEY_SPREAD_DAYS = 60                # survey sent = purchase + event_id mod 60
COMMENT_DOC_STRIDE = 15                # comment = documents.text of doc_id = order_id div 15
COMMENT_MOD = 5                        # ... when order_id mod 5 < 2
COMMENT_BELOW = 2
PAYMENT_SURCHARGES = ((50, "0.50"), (125, "2.00"))   # (order_id modulus, extra amount)
PAYMENT_TYPES = ("credit_card", "boleto", "debit_card")
PAYMENT_UNDEFINED_MOD = 97             # order_id mod 97 = 0 -> payment type 'not_defined'
PAYMENT_INSTALLMENT_MOD = 10
BRAND_WITHOUT_CATEGORY = "Brand#25"    # products of this brand have no category
UNTRANSLATED_BRANDS = {"Brand#7": "brand_07_manual", "Brand#19": "brand_19_manual"}
SELLER_SHORT_CHARS = 8                 # short seller label = last 8 characters of s_name

# --- fixed values: business rules -----------------------------------------------------------------
LOW_SCORE_MAX = 2                      # score <= 2 is a low score
OUTCOMES = ("On time", "Late", "Not delivered", "Unknown")
# delay bands of delivered orders: label, first and last day of delay; the two outcomes without a delay follow
DELAY_RULES = (("On time", None, 0), ("Late 1-3 days", 1, 3), ("Late 4-7 days", 4, 7), ("Late 8-14 days", 8, 14), ("Late 15+ days", 15, None))
DELAY_BANDS = tuple(label for label, _, _ in DELAY_RULES) + ("Not delivered", "Unknown")
LATE_BANDS = DELAY_BANDS[1:5]
Z_95 = 1.96

# --- fixed values: bands and thresholds of the cuts ------------------------------------------------
DELIVERY_BANDS = ((None, 7, "0-7 days"), (None, 14, "8-14 days"), (None, 21, "15-21 days"),
                  (None, 28, "22-28 days"))          # first matching upper bound; else "29+ days"
DELIVERY_BAND_OTHER = "29+ days"
# money is the driver's extended price (order values of 10^3..10^6), so value bands are scaled
VALUE_BANDS = ((50000, "under 50k"), (100000, "50k-100k"), (200000, "100k-200k"), (500000, "200k-500k"))
VALUE_BAND_OTHER = "500k+"
# freight is price x tax (0-8 %), so freight-ratio bands are scaled to that range
FREIGHT_BANDS = ((0.02, "freight under 2% of price"), (0.04, "freight 2-4% of price"),
                 (0.06, "freight 4-6% of price"))
FREIGHT_BAND_OTHER = "freight 6%+ of price"
REVIEW_TIMING = ("answered before delivery", "answered after delivery")
HANDOVER_LABELS = ("handed over after the deadline", "handed over in time")
SHIPMENT_LABELS = ("same state", "different states")
COMPOSITION = (("1 item", 1), ("2+ units of the same product", 2), ("2+ different products, one seller", 3),
               ("2+ items from different sellers", 4))
SCORE_CLASSES = ("1-2 stars", "3 stars", "4-5 stars")
SIZE_CLASSES = ("1 item", "2+ items")
MIN_SELLER_ORDERS = 440                # of the seller base and ranking; sellers have 380 to 520 orders at any scale
SELLER_SUPPORT = 30                    # of the seller deciles
MIN_STATE_ORDERS = 450
MIN_SELLER_STATE_ORDERS = 300
MIN_CATEGORY_ORDERS = 1700             # of the category matrix
CATEGORY_SUPPORT = 500                 # of the category cuts
LARGE_CATEGORY_SHARE = 0.03
TOP_CATEGORIES = 15
WORST_CATEGORIES = 10
WORST_MONTHS = 3
DECILES = 10
COHORT_END = "1997-01-01"              # first orders in the first year of the period

# --- fixed values: review sampling ------------------------------------------------------------------
SAMPLE_SEED = "20261002"               # text appended to ids before hashing (reproducible draw)
SAMPLE_SIZE = 60
PILOT_PER_GROUP = 5
RECODE_SIZE = 10
DELIVERY_GROUPS = ("On time, single item", "On time, several items", "Late", "Not delivered")
# white space as Python's str.strip and \s see it, for a regex character class
WHITE_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PHONE_PATTERN = rf"(?:\p{{Nd}}[{WHITE_SPACE}.\-]?){{9,}}"   # runs of 9+ digits of any script, optional separators
PHONE_MASK = "[number removed] "

# --- fixed values: coding codebook (8 categories, in codebook order) ---------------------------------
CATEGORIES = ("Not received", "Late delivery", "Incomplete order", "Wrong item", "Damaged or defective",
              "Poor quality or not as described", "Seller service and refunds", "Other or unclear")
DELIVERY_CATEGORIES = ("Not received", "Late delivery")
CONTENT_CATEGORIES = ("Incomplete order", "Wrong item", "Damaged or defective", "Poor quality or not as described")
FAMILIES = ("Delivery (not received or late)", "What arrived (incomplete, wrong, damaged, poor quality)",
            "Service and other")
# deck variant: four families of the primary category, reported per delivery group
FAMILIES_4 = ("Not received or late", "Part of the order missing", "Wrong, damaged or poor product",
              "Service or unclear")
FAMILY_4_OF = {
    "Not received": "Not received or late", "Late delivery": "Not received or late",
    "Incomplete order": "Part of the order missing",
    "Wrong item": "Wrong, damaged or poor product", "Damaged or defective": "Wrong, damaged or poor product",
    "Poor quality or not as described": "Wrong, damaged or poor product",
    "Seller service and refunds": "Service or unclear", "Other or unclear": "Service or unclear",
}
SERVICE_CATEGORY = "Seller service and refunds"   # deck figure: share of coded reviews mentioning it
SECONDARY_EVERY = 3                    # doc_id mod 3 = 0 -> secondary category = (primary + doc_id div 3) mod 8, at times the primary itself
QUOTE_EVERY = 7                        # doc_id mod 7 = 0 -> marked as a quote candidate

# --- fixed values: what-if scenarios -----------------------------------------------------------------
SCENARIO_TOP_STATES = 5
SCENARIO_CASES = (("Low", 0.50), ("Base", 0.75), ("High", 1.00))
PERIOD_MONTHS = 60
SLOW_ON_TIME_DAYS = 22

# --- fixed values: dashboard visuals and slicers ----------------------------------------------------
TOP_SELLERS = 10
TOP_MATRIX_CATEGORIES = 12
SLICER_YEAR = 1998
QUARTER = (1998, 2)
SLICER_REGION = "EUROPE"

# --- fixed values: profiling ---------------------------------------------------------------------------
RAW_KEYS = {                            # row order used for "first example" (A16)
    "orders": ("order_id",), "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"), "order_reviews": ("review_id", "order_id"),
    "customers": ("customer_id",), "sellers": ("seller_id",), "products": ("product_id",),
    "category_translation": ("product_category_name",), "geolocation": ("geolocation_zip_code_prefix",),
}
KEY_CANDIDATES = (
    ("orders", ("order_id",)), ("customers", ("customer_id",)), ("customers", ("customer_unique_id",)),
    ("order_items", ("order_id", "order_item_id")), ("order_payments", ("order_id", "payment_sequential")),
    ("order_reviews", ("review_id",)), ("order_reviews", ("order_id",)), ("order_reviews", ("review_id", "order_id")),
    ("sellers", ("seller_id",)), ("products", ("product_id",)), ("category_translation", ("product_category_name",)),
    ("geolocation", ("geolocation_zip_code_prefix",)),
)
RELATIONSHIPS = (
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("products", "product_category_name", "category_translation", "product_category_name"),
    ("customers", "customer_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix"),
    ("sellers", "seller_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix"),
)
SKETCH_TURN = "1998-01-01 00:00:00"    # sketches of earlier purchases are stored first, later ones merged in
LATE_LIMIT_TS = "2001-06-30 23:59:59"  # shipping limits after the data's horizon
PLAUSIBLE_BOX = {"c_acctbal": (0, 9000), "c_nationkey": (1, 20)}   # rows outside in one column or the other count

# --- fixed values: labels of the check lists -----------------------------------------------------------
CHECK_LABELS = {
    "A1": "all orders", "A2": "orders never handed over", "A3": "orders older than the window", "A4": "orders newer than the window",
    "A5": "orders inside the window", "A6": "dated deliveries inside the window", "A7": "dated deliveries overall",
    "A8": "orders rated low at last", "A9": "rated low at last and never handed over",
    "B1": "handed over, no arrival date", "B2": "arrival date, never handed over", "B3": "arrival precedes purchase", "B4": "arrival precedes handover",
    "B5": "handover precedes purchase", "B6": "handover precedes approval", "B7": "approval precedes purchase", "B8": "promise precedes purchase day",
    "B9": "dated delivery, no approval", "B10": "dated delivery, no handover", "B11": "arrived on the promised day", "B12": "arrived after the promised day",
    "B13": "arrived after the promised moment", "B14": "over 60 days under way", "B15": "over 30 days past the promise",
    "C1": "price not positive", "C2": "free freight", "C3": "freight dearer than the goods", "C4": "price beyond 100,000",
    "C5": "orders on both sides", "C6": "sides a cent or more apart", "C7": "sides over a unit apart", "C8": "empty payments", "C9": "payments of no defined type",
    "D1": "reviews", "D2": "orders reviewed", "D3": "orders reviewed repeatedly", "D4": "reviewed repeatedly, scores unlike", "D5": "reviews superseded by a later one",
    "D6": "review ids spanning orders", "D7": "reviews under such ids", "D8": "such ids, score or comment unlike", "D9": "such ids, several people",
    "D10": "comments of blanks alone", "D11": "orders never reviewed", "D12": "last review answered before arrival", "D13": "review ids low and commented",
    "D14": "in time and reviewed", "D15": "in time, asked within a day of arrival", "D16": "late and reviewed", "D17": "late, asked within three days of the promise",
    "D18": "late, asked before arrival",
    "E1": "items", "E2": "items lacking a category", "E3": "items, category untranslated", "E4": "orders of several sellers", "E5": "orders of several categories",
    "E6": "people of several states", "E7": "customers, prefix unknown", "E8": "sellers, prefix unknown", "E9": "customers lacking a state", "E10": "sellers lacking a state",
}
TRAP_LABELS = (
    "customer rows", "customers told apart", "customers under several ids", "orders handed over", "orders handed over, no arrival date",
    "orders with an arrival date, never handed over", "orders of several items", "orders of several sellers", "items due past the horizon",
    "payments without instalments", "payments of nothing", "review ids on several rows", "review ids on several orders", "orders with several reviews",
    "reviews with words", "low reviews", "low reviews with words", "products lacking a category", "reviews lacking every text", "products weighing nothing",
    "categories lacking a translation", "document rows", "document rows repeating a text", "prefixes told apart", "prefixes of several states",
    "customers outside the plausible box",
)
TEST_LABELS = (
    ("Row counts", "orders kept"), ("Row counts", "items kept"), ("Row counts", "people kept"), ("Row counts", "orders by person add up"), ("Row counts", "days without gaps"),
    ("Unique keys", "order"), ("Unique keys", "order and item number"), ("Unique keys", "person"), ("Unique keys", "seller"), ("Unique keys", "seller's short name"),
    ("Unique keys", "product"), ("Unique keys", "day"), ("Unique keys", "state"),
    ("Relationships", "order to person"), ("Relationships", "order to day"), ("Relationships", "order to state"), ("Relationships", "item to order"),
    ("Relationships", "item to product"), ("Relationships", "item to seller"), ("Relationships", "seller to region"), ("Relationships", "product to category"),
    ("Value reconciliation", "price of items"), ("Value reconciliation", "price of orders"), ("Value reconciliation", "freight of orders"),
    ("Value reconciliation", "items by order add up"), ("Value reconciliation", "orders without items"),
    ("Reviews", "orders reviewed"), ("Reviews", "reviewed, no score"), ("Reviews", "score, not reviewed"), ("Reviews", "score off the scale"),
    ("Delivery logic", "delivered"), ("Delivery logic", "late"), ("Delivery logic", "in time and late make up delivered"), ("Delivery logic", "in-time flag without delivery"),
    ("Delivery logic", "in-time flag against outcome"), ("Delivery logic", "negative durations"), ("Delivery logic", "never handed over"),
)
