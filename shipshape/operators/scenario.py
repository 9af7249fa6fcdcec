"""What-if sizing. Inputs are conditional aggregates; the scenario x case grid is built by
exploding a fixed case list on the (few) scenario input rows, so no driver round trip is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shipshape import config as C
from shipshape.functions.exprs import count_if, one_row, ratio
from shipshape.sources.files import as_variant

f = F.col


def base_totals(fact: DataFrame) -> DataFrame:
    """Delivered, late, reviewed, low, score sum and the derived national rates (one row)."""
    return fact.agg(count_if(f("is_delivered")).alias("delivered"),
                    count_if(f("delivery_outcome") == "Late").alias("late"),
                    count_if(f("has_review")).alias("reviewed"), count_if(f("is_low_score")).alias("low"),
                    F.sum("review_score").cast("bigint").alias("score_sum")).select(
        "*", ratio(f("late"), f("delivered")).alias("national_late_rate"), ratio(f("low"), f("reviewed")).alias("low_share"),
        ratio(f("score_sum"), f("reviewed")).alias("avg_score"))


def state_inputs(fact: DataFrame, geo: DataFrame) -> DataFrame:
    """Per-state inputs with the excess of late orders over the national rate."""
    nat = one_row(base_totals(fact))["national_late_rate"]   # same subquery as the scenario's other base reads
    g = geo.select(f("state_code").alias("customer_state"), "state_name")
    late, on = f("delivery_outcome") == "Late", f("delivery_outcome") == "On time"
    x = fact.join(g, "customer_state", "inner")
    return x.groupBy(f("customer_state").alias("state"), "state_name").agg(
        count_if(f("is_delivered")).alias("delivered"), count_if(late).alias("late"),
        (count_if(late) - count_if(f("is_delivered")) * nat).alias("excess_late"),
        count_if(late & f("has_review")).alias("late_reviewed"), count_if(late & f("is_low_score")).alias("late_low"),
        F.sum(F.when(late, f("review_score"))).cast("bigint").alias("late_score_sum"),
        count_if(on & f("has_review")).alias("on_reviewed"), count_if(on & f("is_low_score")).alias("on_low"),
        F.sum(F.when(on, f("review_score"))).cast("bigint").alias("on_score_sum"))


def _pool(states: DataFrame, label: str) -> DataFrame:
    s = states
    return s.agg(*[F.sum(c).cast("double").alias(c) for c in
                   ("delivered", "late", "excess_late", "late_reviewed", "late_low", "late_score_sum",
                    "on_reviewed", "on_low", "on_score_sum")], F.count(F.lit(1)).cast("bigint").alias("states")
                 ).select(F.lit(label).alias("target"), "states",
                          f("excess_late").alias("orders_moved"),
                          ratio(f("late_reviewed"), f("late")).alias("reviewed_share"),
                          ratio(f("late_low"), f("late_reviewed")).alias("bad_from"),
                          ratio(f("on_low"), f("on_reviewed")).alias("bad_to"),
                          ratio(f("late_score_sum"), f("late_reviewed")).alias("score_from"),
                          ratio(f("on_score_sum"), f("on_reviewed")).alias("score_to"),
                          ratio(f("late"), f("delivered")).alias("late_rate_before"))


def scenario_a_targets(states: DataFrame, base: DataFrame, top: int = C.SCENARIO_TOP_STATES) -> DataFrame:
    """Z3 + Z8: pooled inputs for the top-N, the top-1 and all states with positive excess, and the
    national late rate after the change."""
    ranked = states.orderBy(f("excess_late").desc(), f("state"))
    parts = [_pool(ranked.limit(top), f"top {top}"), _pool(ranked.limit(1), "top 1"),
             _pool(states.filter(f("excess_late") > 0), "all above national")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    b = one_row(base)
    late, delivered = b["late"], b["delivered"]
    return out.select("*", ratio(late - f("orders_moved"), delivered).alias("national_late_after"))


def scenario_b_inputs(fact: DataFrame) -> DataFrame:
    """On-time several-item orders moved to the single-item review profile."""
    x = fact.filter(f("delivery_outcome") == "On time")
    m, s1 = f("item_count") >= 2, f("item_count") == 1
    return x.agg(count_if(m & f("has_review")).alias("multi_reviewed"), count_if(m & f("is_low_score")).alias("multi_low"),
                 F.sum(F.when(m, f("review_score"))).alias("multi_score_sum"),
                 count_if(s1 & f("has_review")).alias("single_reviewed"), count_if(s1 & f("is_low_score")).alias("single_low"),
                 F.sum(F.when(s1, f("review_score"))).alias("single_score_sum")).select(
        F.lit("B").alias("target"), f("multi_reviewed").cast("double").alias("reviews_moved"),
        ratio(f("multi_low"), f("multi_reviewed")).alias("bad_from"),
        ratio(f("single_low"), f("single_reviewed")).alias("bad_to"),
        ratio(f("multi_score_sum"), f("multi_reviewed")).alias("score_from"),
        ratio(f("single_score_sum"), f("single_reviewed")).alias("score_to"))


def scenario_grid(targets: DataFrame, b: DataFrame, base: DataFrame, top: int = C.SCENARIO_TOP_STATES,
                  cases=C.SCENARIO_CASES, months: int = C.PERIOD_MONTHS) -> DataFrame:
    """effect = moved x gap x factor for every scenario and case, A+B as the sum of A(top N) and B."""
    a = targets.select(F.concat(F.lit("A: "), f("target")).alias("scenario"),
                       (f("orders_moved") * f("reviewed_share")).alias("reviews_moved"),
                       "bad_from", "bad_to", "score_from", "score_to")
    inputs = a.unionByName(b.select(F.lit("B").alias("scenario"), "reviews_moved", "bad_from", "bad_to",
                                    "score_from", "score_to"))
    case_arr = F.array(*[F.struct(F.lit(n).alias("case"), F.lit(v).alias("factor")) for n, v in cases])
    x = inputs.select("*", F.explode(case_arr).alias("_c")).select("*", "_c.case", "_c.factor").drop("_c")
    x = x.select("scenario", "case", "factor",
                 (f("reviews_moved") * (f("bad_from") - f("bad_to")) * f("factor")).alias("avoided"),
                 (f("reviews_moved") * (f("score_to") - f("score_from")) * f("factor")).alias("score_points"))
    ab = (x.filter(f("scenario").isin(f"A: top {top}", "B")).groupBy("case", "factor")
          .agg(F.sum("avoided").alias("avoided"), F.sum("score_points").alias("score_points"))
          .select(F.lit("A+B").alias("scenario"), "case", "factor", "avoided", "score_points"))
    x = x.unionByName(ab)
    b = one_row(base)
    low, reviewed, low_share, avg = b["low"], b["reviewed"], b["low_share"], b["avg_score"]
    new_low = ratio(low - f("avoided"), reviewed)
    new_avg = avg + f("score_points") / reviewed
    return x.select("scenario", "case", "factor", "avoided", (f("avoided") / months).alias("avoided_per_month"),
                    ratio(f("avoided"), low).alias("share_of_all_bad"), new_low.alias("new_low_share"),
                    ((new_low - low_share) * 100).alias("change_pp"), new_avg.alias("new_avg_score"),
                    (new_avg - avg).alias("score_change"))


def _late_on(fact: DataFrame) -> DataFrame:
    late, on = f("delivery_outcome") == "Late", f("delivery_outcome") == "On time"
    return fact.agg(count_if(late & f("has_review")).alias("late_reviewed"), count_if(late & f("is_low_score")).alias("late_low"),
                    count_if(on & f("has_review")).alias("on_reviewed"), count_if(on & f("is_low_score")).alias("on_low"))


def scenario_ceiling(fact: DataFrame, base: DataFrame) -> DataFrame:
    """Every late order on time with the full observed gap."""
    x = _late_on(fact)
    ceiling = f("late_reviewed") * (ratio(f("late_low"), f("late_reviewed")) - ratio(f("on_low"), f("on_reviewed")))
    b = one_row(base)
    low, reviewed = b["low"], b["reviewed"]
    return x.select(ceiling.alias("ceiling"), ratio(ceiling, low).alias("share_of_all_bad"),
                    ratio(low - ceiling, reviewed).alias("new_low_share"))


def scenario_anchor(fact: DataFrame, min_days: int = C.SLOW_ON_TIME_DAYS) -> DataFrame:
    """Slow on-time orders as an anchor: share of the late/on-time gap realised."""
    slow = fact.filter((f("delivery_outcome") == "On time") & (f("delivery_days") >= min_days)).agg(
        count_if(f("has_review")).alias("slow_reviewed"), count_if(f("is_low_score")).alias("slow_low"))
    x = _late_on(fact)
    p_late = ratio(f("late_low"), f("late_reviewed"))
    p_on = ratio(f("on_low"), f("on_reviewed"))
    sl = one_row(slow)
    p_slow = ratio(sl["slow_low"], sl["slow_reviewed"])
    return x.select(sl["slow_reviewed"].alias("slow_reviewed"), p_slow.alias("p_slow"),
                    p_on.alias("p_on"), p_late.alias("p_late"), F.try_divide(p_late - p_slow, p_late - p_on).alias("realised"))


def scenario_section(grid: DataFrame, targets: DataFrame, b: DataFrame, ceiling: DataFrame, states: DataFrame,
                     cases=C.SCENARIO_CASES, top: int = C.SCENARIO_TOP_STATES) -> DataFrame:
    """The scenario as one nested document: inputs, the effect of each scenario by case, and the ceiling (one row, ``doc``)."""
    measures = ("avoided", "share_of_all_bad", "new_low_share")
    effects = {"a": f"A: top {top}", "b": "B", "ab": "A+B"}
    aggs = [F.max(F.when((f("scenario") == label) & (f("case") == case), f(m))).alias(f"{key}_{case}_{m}")
            for key, label in effects.items() for case, _ in cases for m in measures]
    g = one_row(grid.agg(*aggs))
    best = states.orderBy(f("excess_late").desc(), f("state")).limit(top)  # ``top`` rows
    names = best.agg(F.transform(F.array_sort(F.collect_list(F.struct((-f("excess_late")).alias("x"), "state"))), lambda r: r["state"])).scalar()
    fields = {"cases": F.struct(*[F.lit(v).alias(n.lower()) for n, v in cases]), "target_states": names,
              "orders_moved_a": targets.where(f("target") == f"top {top}").agg(F.max("orders_moved")).scalar(),
              "reviews_moved_b": b.agg(F.max("reviews_moved")).scalar()}
    for key in effects:
        fields[key] = F.struct(*[F.struct(*[g[f"{key}_{case}_{m}"].alias(m) for m in measures]).alias(case.lower()) for case, _ in cases])
    c = one_row(ceiling)
    fields |= {"ceiling_avoided": c["ceiling"], "ceiling_share_of_all_bad": c["share_of_all_bad"]}
    return grid.sparkSession.range(1).select(as_variant(fields).alias("doc"))


def section_paths(cases=C.SCENARIO_CASES, top: int = C.SCENARIO_TOP_STATES) -> list[str]:
    """Every path to a leaf of the scenario section."""
    leaves = [f"{key}.{case.lower()}.{m}" for key in ("a", "b", "ab") for case, _ in cases for m in ("avoided", "share_of_all_bad", "new_low_share")]
    return [*(f"cases.{n.lower()}" for n, _ in cases), *(f"target_states[{i}]" for i in range(top)), "orders_moved_a", "reviews_moved_b", *leaves,
            "ceiling_avoided", "ceiling_share_of_all_bad"]
