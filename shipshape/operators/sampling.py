"""Sampling frame, proportional allocation (largest remainder), reproducible stratified draw
by hash rank, pilot and re-coding subsets, text masking, blind split and sample checks.

Ranks come from ``md5(id || seed)``: deterministic on every partition and every rerun (no RNG).
Per-stratum positions are only needed up to sample + pilot size, a literal bound, so Spark plans a
partial WindowGroupLimit before the shuffle: a stratum holding a third of the frame never reaches one
task whole. Strata (a handful of rows) and the drawn sample (a parameter-sized set) are the only
data ever windowed without a partition key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shipshape import config as C
from shipshape.functions.exprs import blank_to_null, count_if, ratio, strip_white_space
from shipshape.operators.rank import top_per_group

f = F.col


def mask_text(c: Column, pattern: str = C.PHONE_PATTERN, mask: str = C.PHONE_MASK) -> Column:
    """Replace phone-like digit runs, then strip surrounding whitespace."""
    return strip_white_space(F.regexp_replace(c, pattern, mask))


def hash_rank(key: Column, seed: str, tag: str = "") -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(seed + tag)))


def delivery_group(outcome: Column, items: Column) -> Column:
    single, several = C.DELIVERY_GROUPS[0], C.DELIVERY_GROUPS[1]
    return (F.when((outcome == "On time") & (items >= 2), several).when(outcome == "On time", single)
            .otherwise(outcome))


def sample_frame(reviews: DataFrame, fact: DataFrame, raw_reviews: DataFrame) -> DataFrame:
    """Low score + comment + known outcome; one row per review id (lowest order id).

    ``reviews``: stg reviews, whose comment is a flag and a document key. Everything is drawn and
    counted on such narrow rows; ``with_comments`` fetches the texts of rows that are shown.
    """
    fact = fact.select("order_id", "delivery_outcome", "delay_band", "delay_days", "item_count", "seller_count",
                       "review_before_delivery", "customer_state")
    r = reviews.filter((f("review_score") <= C.LOW_SCORE_MAX) & f("has_comment"))
    x = (r.join(fact.filter(f("delivery_outcome") != "Unknown"), "order_id", "inner")
         .join(raw_reviews.select("review_id", "order_id", "review_comment_title"), ["review_id", "order_id"], "inner"))
    cols = ["order_id", "review_score", "review_comment_title", "delivery_group", "delivery_outcome",
            "delay_band", "delay_days", "item_count", "seller_count", "review_before_delivery", "customer_state",
            "comment_doc_id"]
    x = x.withColumn("delivery_group", delivery_group(f("delivery_outcome"), f("item_count")))
    # one row per review id: the row with the lowest order id (partial aggregation, skew-safe)
    picked = x.groupBy("review_id").agg(F.min_by(F.struct(*[f(c) for c in cols]), f("order_id")).alias("_r"))
    return picked.select("review_id", *[f(f"_r.{c}").alias(c) for c in cols])


def with_comments(rows: DataFrame, docs: DataFrame, few: bool) -> DataFrame:
    """Rows with the cleaned text of their comment in place of its document key.

    ``few``: the rows are a drawn sample, whose size is a parameter; they are sent to the scan of the
    documents, so no text is shuffled. Otherwise both sides are dealt by key.
    """
    text = docs.select(f("doc_id").alias("comment_doc_id"), blank_to_null(f("text")).alias("review_comment_message"))
    side = F.broadcast(rows) if few else rows
    return text.join(side, "comment_doc_id", "inner").drop("comment_doc_id")


def stratum_sizes(frame: DataFrame) -> DataFrame:
    """R2."""
    return frame.groupBy("delivery_group").agg(F.count(F.lit(1)).cast("bigint").alias("frame_size"))


def allocation(sizes: DataFrame, n: int = C.SAMPLE_SIZE) -> DataFrame:
    """Proportional allocation; floors, then the leftover to the largest remainders
    (tie-break: larger stratum, then label). Runs on the strata table (one row per stratum)."""
    total = f("_total")
    w_all = Window.partitionBy()
    x = sizes.withColumn("_total", F.sum("frame_size").over(w_all))
    x = x.withColumn("exact", F.lit(n) * f("frame_size").cast("double") / total)
    x = x.withColumn("_floor", F.floor("exact").cast("bigint"))
    x = x.withColumn("_left", F.lit(n) - F.sum("_floor").over(w_all))
    w = Window.partitionBy().orderBy((f("exact") - f("_floor")).desc(), f("frame_size").desc(), f("delivery_group"))
    x = x.withColumn("_rk", F.row_number().over(w))
    return x.select("delivery_group", "frame_size", "exact",
                    (f("_floor") + F.when(f("_rk") <= f("_left"), 1).otherwise(0)).cast("bigint").alias("allocated"))


def ranked(frame: DataFrame, k: int, seed: str = C.SAMPLE_SEED) -> DataFrame:
    """Position inside the stratum by hash, kept up to a literal bound k."""
    x = frame.withColumn("_h", hash_rank(f("review_id"), seed))
    return top_per_group(x, ["delivery_group"], [f("_h"), f("review_id")], k).drop("_h")


def stratified_sample(frame: DataFrame, n: int = C.SAMPLE_SIZE, pilot: int = C.PILOT_PER_GROUP,
                      seed: str = C.SAMPLE_SEED) -> tuple[DataFrame, DataFrame]:
    """R4 + R5: the sample (position <= allocated) with a shuffled sample_id, and the pilot set
    (the next ``pilot`` positions per stratum)."""
    alloc = allocation(stratum_sizes(frame), n).select("delivery_group", "allocated")
    r = ranked(frame, n + pilot, seed).join(F.broadcast(alloc), "delivery_group", "inner")
    sample = r.filter(f("position") <= f("allocated"))
    w = Window.partitionBy().orderBy(hash_rank(f("review_id"), seed, "order"), f("review_id"))
    sample = sample.withColumn("sample_id", F.row_number().over(w).cast("bigint")).drop("allocated")
    pilot_df = r.filter((f("position") > f("allocated")) & (f("position") <= f("allocated") + pilot)).drop("allocated")
    return sample, pilot_df


def recode_sample(sample: DataFrame, size: int = C.RECODE_SIZE, seed: str = C.SAMPLE_SEED) -> DataFrame:
    """A hash-chosen subset of the sample, re-shuffled with its own id."""
    sub = sample.orderBy(hash_rank(f("review_id"), seed, "recode"), f("review_id")).limit(size)
    w = Window.partitionBy().orderBy(hash_rank(f("review_id"), seed, "recode order"), f("review_id"))
    return sub.withColumn("recode_id", F.row_number().over(w).cast("bigint"))


TEXT_COLUMNS = ("review_comment_title", "review_comment_message")


def masked(df: DataFrame, text_columns=TEXT_COLUMNS) -> DataFrame:
    """P20: mask only the listed free-text columns."""
    return df.select(*[mask_text(f(c)).alias(c) if c in text_columns else f(c) for c in df.columns])


def blind_text(sample: DataFrame) -> DataFrame:
    """What the coder sees (``sample`` with its comments)."""
    return masked(sample.select("sample_id", "review_score", "review_comment_title", "review_comment_message"))


def sample_key(sample: DataFrame) -> DataFrame:
    """What links the coder's rows back."""
    return sample.select("sample_id", "review_id", "order_id", "delivery_group", "delivery_outcome", "delay_band",
                         "delay_days", "item_count", "seller_count", "review_before_delivery", "customer_state")


def sample_checks(sample: DataFrame, pilot: DataFrame, recode: DataFrame) -> DataFrame:
    """Rows, distinct ids and orders, overlap with the pilot, recode size (one row)."""
    overlap = sample.select("review_id").join(pilot.select("review_id"), "review_id", "inner")
    return sample.agg(
        F.count(F.lit(1)).cast("bigint").alias("sample_rows"),
        F.count_distinct("review_id").cast("bigint").alias("distinct_reviews"),
        F.count_distinct("order_id").cast("bigint").alias("distinct_orders"),
        count_if(f("review_score") == 1).alias("score_1"), count_if(f("review_score") == 2).alias("score_2"),
    ).select("*", overlap.agg(F.count(F.lit(1))).scalar().alias("pilot_overlap"),
             pilot.agg(F.count(F.lit(1))).scalar().alias("pilot_rows"),
             recode.agg(F.count(F.lit(1))).scalar().alias("recode_rows"))


def sample_mix(frame: DataFrame, sample: DataFrame) -> DataFrame:
    """Sample vs frame share per stratum."""
    fr = stratum_sizes(frame)
    s = sample.groupBy("delivery_group").agg(F.count(F.lit(1)).cast("bigint").alias("sample_n"))
    ft = frame.agg(F.count(F.lit(1))).scalar()
    st = sample.agg(F.count(F.lit(1))).scalar()
    return (fr.join(s, "delivery_group", "left")
            .select("delivery_group", "frame_size", ratio(f("frame_size"), ft).alias("frame_share"),
                    F.coalesce(f("sample_n"), F.lit(0)).cast("bigint").alias("sample_n"),
                    ratio(F.coalesce(f("sample_n"), F.lit(0)), st).alias("sample_share")))
