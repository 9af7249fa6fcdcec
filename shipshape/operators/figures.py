"""S13/S14 over the deck figures: one figure document per section, encoded as JSON in Spark and
decoded again (what a consumer of the document reads), returned in long form.

Every section is a small grouped result of the star (a handful of rows: KPI total, delay bands,
outcomes, statuses); the document rows are gathered by ``collect_list`` per section only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from shipshape import config as C
from shipshape.functions.exprs import count_if, ratio
from shipshape.operators.cuts import first_orders
from shipshape.sources.files import figures_document

f = F.col

# --- fixed values: KPI total figures carried into the document ---------------------------------------
BASELINE_KEYS = ("orders", "gmv", "on_time_rate", "late_rate", "not_delivered_rate", "avg_review_score",
                 "low_score_rate", "low_score_orders", "reviewed_orders", "delivered_orders", "late_orders",
                 "not_delivered_orders", "median_delivery_days")
PROBLEM_OUTCOMES = ("Late", "Not delivered")


def figure_sections(fact: DataFrame, kpi: DataFrame, orders: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """Sections of the figure document; each has an ``item`` label and numeric measures."""
    low, reviewed = count_if(f("is_low_score")), count_if(f("has_review"))
    baseline = kpi.filter(f("period") == "Total").select(
        F.lit("Total").alias("item"), *[f(k).cast("double").alias(k) for k in BASELINE_KEYS])
    bands = fact.filter(f("delay_band") != "Unknown").groupBy(f("delay_band").alias("item")).agg(
        F.count(F.lit(1)).alias("orders"), ratio(low, reviewed).alias("low_share"))
    known = fact.filter(f("delivery_outcome") != "Unknown")
    by_outcome = known.groupBy(f("delivery_outcome").alias("item")).agg(
        F.count(F.lit(1)).alias("orders"), low.alias("low_orders"), ratio(low, reviewed).alias("low_share"))
    every = Window.partitionBy()                 # over the outcome rows only (at most four)
    outcomes = by_outcome.select(
        "item", "orders", ratio(f("orders"), F.sum("orders").over(every)).alias("share_of_orders"), "low_orders",
        ratio(f("low_orders"), F.sum("low_orders").over(every)).alias("share_of_low"), "low_share")
    problem = f("delivery_outcome").isin(*PROBLEM_OUTCOMES)
    problem_share = known.agg(
        ratio(count_if(problem), F.count(F.lit(1))).alias("share_of_orders"),
        ratio(count_if(problem & f("is_low_score")), low).alias("share_of_low")).select(
        F.lit(" + ".join(PROBLEM_OUTCOMES)).alias("item"), "share_of_orders", "share_of_low")
    not_delivered = fact.filter(f("delivery_outcome") == "Not delivered").groupBy(f("order_status").alias("item")).agg(
        F.count(F.lit(1)).alias("orders"), low.alias("low_orders"))
    first = first_orders(fact, orders).filter(f("delivery_outcome").isin("On time", "Late"))
    repeat = (first.join(customers.select("customer_unique_id", "is_repeat_customer"), "customer_unique_id", "inner")
              .groupBy(f("delivery_outcome").alias("item"))
              .agg(F.count(F.lit(1)).alias("customers"), count_if(f("is_repeat_customer")).alias("repeat_customers")))
    return {"baseline": baseline, "delay_bands": bands, "outcomes": outcomes, "problem_share": problem_share,
            "not_delivered_by_status": not_delivered, "repeat": repeat}


def _decoded_schema(df: DataFrame) -> T.StructType:
    fields = [T.StructField(x.name, T.DoubleType() if isinstance(x.dataType, T.DecimalType) else x.dataType)
              for x in df.schema.fields]
    return T.StructType([T.StructField("section", T.StringType()),
                         T.StructField("rows", T.ArrayType(T.StructType(fields)))])


def figures_long(sections: dict[str, DataFrame]) -> DataFrame:
    """Encode the sections as JSON documents (S13), decode each (S14) and unpivot to
    (section, item, measure, value)."""
    doc = figures_document(sections)
    out = None
    for name, df in sections.items():
        d = (doc.filter(f("section") == name)
             .select(F.explode(F.from_json(f("json"), _decoded_schema(df)).getField("rows")).alias("r"))
             .select("r.*"))
        measures = [c for c in d.columns if c != "item"]
        parts = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in measures)
        x = d.selectExpr(f"'{name}' AS section", "item", f"stack({len(measures)}, {parts}) AS (measure, value)")
        out = x if out is None else out.unionByName(x)
    return out
