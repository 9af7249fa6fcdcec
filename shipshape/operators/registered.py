"""Query registrations: SURVEY §7.3 keys -> plans over the star."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipshape import config as C
from shipshape.functions import exprs
from shipshape.functions.exprs import count_if, ratio
from shipshape.catalog import query
from shipshape.operators import cuts, kpis
from shipshape.plans.star import numbered_facts, stg_reviews_text

f = F.col


def fo(s):
    return s.model["fact_orders"]


def fi(s):
    return s.model["fact_order_items"]


def _kpi(s):
    return kpis.kpi_orders(fo(s), s.model["dim_date"])


# --- step 0-1: star ------------------------------------------------------------------------------
@query("kpi_orders")
def _kpi_orders(s):
    return _kpi(s)


@query("stg_orders")
def _stg_orders(s):
    return s.stg["orders"]


@query("stg_reviews_latest")
def _stg_reviews(s):
    return stg_reviews_text(s.stg["reviews"], s.tables)


@query("stg_order_items")
def _stg_items(s):
    return s.stg["order_items"]


for _name in ("dim_date", "dim_geography", "dim_product", "dim_seller", "dim_customer", "fact_order_items"):
    query(_name)(lambda s, _n=_name: s.model[_n])


@query("fact_orders")
def _fact_orders(s):
    return numbered_facts(s)


# --- step 2: KPIs ------------------------------------------------------------------------------------
@query("kpi_customers")
def _kpi_customers(s):
    return kpis.kpi_customers(s.model["dim_customer"])


@query("kpi_sheet")
def _kpi_sheet(s):
    return kpis.kpi_sheet(_kpi(s), kpis.kpi_customers(s.model["dim_customer"]))


@query("supporting_figures")
def _supporting(s):
    return kpis.supporting_figures(fo(s), s.model["dim_customer"])


@query("score_distribution")
def _scores(s):
    return kpis.score_distribution(fo(s))


@query("kpi_monthly")
def _kpi_monthly(s):
    return kpis.kpi_monthly(_kpi(s))


# --- step 6: delivery cuts ---------------------------------------------------------------------------
query("by_outcome")(lambda s: cuts.by_outcome(fo(s)))
query("by_delay_band")(lambda s: cuts.by_delay_band(fo(s)))
query("not_delivered_by_status")(lambda s: cuts.not_delivered_by_status(fo(s)))
query("late_review_timing")(lambda s: cuts.late_review_timing(fo(s)))
query("on_time_by_speed")(lambda s: cuts.on_time_by_speed(fo(s)))
query("time_decomposition")(lambda s: cuts.time_decomposition(fo(s)))
query("monthly_rates_corr")(lambda s: cuts.monthly_rates_corr(_kpi(s)))
query("gap_region_range")(lambda s: cuts.gap_region_range(fo(s), s.model["dim_geography"]))
query("worst_months")(lambda s: cuts.worst_months(_kpi(s)))
query("outcome_share_known")(lambda s: cuts.outcome_share_known(fo(s)))
query("on_time_order_size")(lambda s: cuts.on_time_order_size(fo(s)))


# --- step 7: composition, categories, sellers, geography, price -----------------------------------
def _tasks(s):
    return s.tables.tasks("orders", "lineitem")


def _cat(s):
    return cuts.category_stats(fi(s), s.model["dim_product"], fo(s), _tasks(s))


def _sellers(s):
    return cuts.seller_stats(fi(s), _tasks(s))


def _cat_once(s):
    return s.once("category_stats", lambda: _cat(s))


def _sellers_once(s):
    """For queries that read the sellers' counts several times (numbers, totals, medians)."""
    return s.once("seller_stats", lambda: _sellers(s))


def _national_late(s):
    """Late rate of all orders (the KPI total row's late_rate), as one aggregate of the facts."""
    return fo(s).agg(ratio(count_if(f("delivery_outcome") == "Late"), count_if(f("is_delivered")))).scalar()


def _overall_low(s):
    """Low-score share of all reviewed orders (the KPI total row's low_score_rate)."""
    return fo(s).agg(ratio(count_if(f("is_low_score")), count_if(f("has_review")))).scalar()


def _states(s):
    return cuts.by_state_excess(fo(s), s.model["dim_geography"], _national_late(s))


query("order_composition")(lambda s: cuts.order_composition(fo(s), fi(s)))
query("composition_on_time_share")(lambda s: cuts.composition_on_time_share(fo(s), fi(s)))
query("category_stats")(_cat)
query("top_categories_gmv")(lambda s: cuts.top_categories_gmv(_cat(s)))
query("worst_categories")(lambda s: cuts.worst_categories(_cat(s)))
query("category_clean_range")(lambda s: cuts.category_clean_range(_cat(s)))
query("category_flags")(lambda s: cuts.category_flags(_cat_once(s), _overall_low(s)))
query("seller_stats")(_sellers)
query("seller_base")(lambda s: cuts.seller_base(_sellers_once(s)))
query("seller_deciles_volume")(lambda s: cuts.seller_deciles_volume(_sellers_once(s)))
query("seller_deciles_late")(lambda s: cuts.seller_deciles_late(_sellers_once(s)))
query("seller_deciles_low")(lambda s: cuts.seller_deciles_low(_sellers_once(s)))
query("worst_decile_summary")(lambda s: cuts.worst_decile_summary(_sellers_once(s)))
query("handover_split")(lambda s: cuts.handover_split(fo(s)))
query("by_region")(lambda s: cuts.by_region(fo(s), s.model["dim_geography"]))
query("by_state_excess")(_states)
query("largest_excess_state")(lambda s: cuts.largest_excess_state(_states(s)))
query("by_seller_state")(lambda s: cuts.by_seller_state(fi(s), s.model["dim_seller"], tasks=_tasks(s)))
query("same_state_split")(lambda s: cuts.same_state_split(fo(s)))
query("value_bands")(lambda s: cuts.value_bands(fo(s)))
query("freight_ratio_bands")(lambda s: cuts.freight_ratio_bands(fo(s)))


# --- step 8: cohorts and robustness ----------------------------------------------------------------
def _first(s):
    return cuts.first_orders(fo(s), s.stg["orders"])


query("repeat_by_first_outcome")(lambda s: cuts.repeat_by(
    _first(s), s.model["dim_customer"], f("delivery_outcome"), f("delivery_outcome") != "Unknown"))
query("repeat_by_first_outcome_cohort")(lambda s: cuts.repeat_by(
    _first(s), s.model["dim_customer"], f("delivery_outcome"),
    (f("delivery_outcome") != "Unknown") & (f("purchase_date") < F.lit(C.COHORT_END).cast("date"))))
query("repeat_by_first_score")(lambda s: cuts.repeat_by(
    _first(s), s.model["dim_customer"], cuts.score_class(f("review_score")), f("has_review")))
query("gap_by_region")(lambda s: cuts.gap_by(
    cuts._with_region(fo(s), s.model["dim_geography"]), f("region")))
query("gap_by_size")(lambda s: cuts.gap_by(fo(s), cuts.size_class(f("item_count"))))
query("gap_by_value")(lambda s: cuts.gap_by(fo(s), cuts.value_band(f("items_value")),
                                            f("items_value").cast("double")))
query("gap_by_year")(lambda s: cuts.gap_by(fo(s), F.year("purchase_date").cast("string")))


# --- step 9-10: sampling and coding ---------------------------------------------------------------
from shipshape.operators import coding, sampling  # noqa: E402
from shipshape.plans.star import review_frame  # noqa: E402


def _frame(s):
    return review_frame(s)


def _drawn(s):
    return sampling.stratified_sample(_frame(s))


def _texts(s, rows, few=True):
    return sampling.with_comments(rows, s.tables.documents, few)


query("sample_frame")(lambda s: _texts(s, _frame(s), few=False))
query("sample_allocation")(lambda s: sampling.allocation(sampling.stratum_sizes(_frame(s))))
query("stratified_sample")(lambda s: _texts(s, _drawn(s)[0]))
query("pilot_sample")(lambda s: _texts(s, _drawn(s)[1]))
query("recode_sample")(lambda s: _texts(s, sampling.recode_sample(_drawn(s)[0])))
query("blind_text")(lambda s: sampling.blind_text(_texts(s, _drawn(s)[0])))
query("sample_key")(lambda s: sampling.sample_key(_drawn(s)[0]))
query("masked_text")(lambda s: s.tables.documents.select(
    "doc_id", sampling.mask_text(f("text")).alias("masked_text")))
query("sample_checks")(lambda s: sampling.sample_checks(
    _drawn(s)[0], _drawn(s)[1], sampling.recode_sample(_drawn(s)[0])))
query("sample_mix")(lambda s: sampling.sample_mix(_frame(s), _drawn(s)[0]))


def _coded(s):
    return coding.coded_reviews(_frame(s), s.tables.documents)


def _cats(s):
    return coding.categories(s.spark)


query("coded_reviews")(lambda s: _texts(s, _coded(s), few=False))
query("coding_violations")(lambda s: coding.coding_violations(_coded(s), _frame(s), _cats(s)))
query("category_shares_ci")(lambda s: coding.category_shares_ci(_coded(s), _cats(s)))
query("category_families")(lambda s: coding.category_families(_coded(s)))
query("category_crosstab")(lambda s: coding.category_crosstab(_coded(s)))
query("family_by_group")(lambda s: coding.family_by_group(_coded(s)))
query("key_shares_ci")(lambda s: coding.key_shares_ci(_coded(s)))
query("tag_counts")(lambda s: coding.tag_counts(_coded(s)))
query("coder_agreement_kappa")(lambda s: coding.coder_agreement(s.tables.labels))
query("coder_disagreements")(lambda s: coding.coder_disagreements(s.tables.labels))
query("quote_candidates")(lambda s: coding.quote_candidates(_texts(s, coding.quoted(_coded(s)), few=False)))
query("mentioned_share")(lambda s: coding.mentioned_share(_frame(s), _coded(s)))
query("service_mentioned_share")(lambda s: coding.mentioned_share(_frame(s), _coded(s), C.SERVICE_CATEGORY))


# --- step 11: what-if ------------------------------------------------------------------------------
from shipshape.operators import scenario  # noqa: E402


def _base(s):
    return scenario.base_totals(fo(s))


def _targets(s):
    return scenario.scenario_a_targets(scenario.state_inputs(fo(s), s.model["dim_geography"]), _base(s))


query("scenario_base")(_base)
query("scenario_inputs")(lambda s: scenario.state_inputs(fo(s), s.model["dim_geography"]))
query("scenario_targets")(_targets)
query("scenario_b_inputs")(lambda s: scenario.scenario_b_inputs(fo(s)))
query("scenario_grid")(lambda s: scenario.scenario_grid(_targets(s), scenario.scenario_b_inputs(fo(s)), _base(s)))
query("scenario_ceiling")(lambda s: scenario.scenario_ceiling(fo(s), _base(s)))
query("scenario_anchor")(lambda s: scenario.scenario_anchor(fo(s)))


# --- step 5: model validation -----------------------------------------------------------------------
from shipshape.operators import validate  # noqa: E402

query("model_validation")(validate.model_validation)


# --- step 12: semantic layer ------------------------------------------------------------------------
from shipshape.operators import semantic  # noqa: E402

query("measures_total")(semantic.measures_total)
query("measures_by_month")(semantic.measures_by_month)
query("share_pair_by_outcome")(semantic.share_pair_by_outcome)
query("state_late_flag")(semantic.state_late_flag)
query("band_visuals")(semantic.band_visuals)
query("seller_ranking")(semantic.seller_ranking)
query("size_by_outcome")(semantic.size_by_outcome)
query("size_shares_by_region")(semantic.size_shares_by_region)
query("complaint_matrix")(lambda s: semantic.complaint_matrix(s, _coded(s)))
query("category_matrix")(semantic.category_matrix)
query("measures_sliced")(semantic.measures_sliced)


# --- step 3: profiling -------------------------------------------------------------------------------
from shipshape.operators import profile  # noqa: E402

query("table_overview")(profile.table_overview)
query("column_profile")(profile.column_profiles)


@query("column_sketches")
def _column_sketches(s):
    """Monthly sketches of the orders, stored year by year, against the exact counts of the same months."""
    import uuid

    from shipshape.operators import sketches
    from shipshape.session import ensure_checkpoint_dir
    orders = s.raw["orders"].select("order_id", "customer_id", "order_status", "order_purchase_timestamp")
    month, columns = F.date_format("order_purchase_timestamp", "yyyy-MM"), ["order_id", "customer_id", "order_status"]
    store = sketches.SketchStore(s.spark, f"{ensure_checkpoint_dir(s.spark).rstrip('/')}/sketches-{uuid.uuid4().hex}")
    turn = F.lit(C.SKETCH_TURN).cast("timestamp_ntz")
    early = f("order_purchase_timestamp") < turn
    for batch in (orders.filter(early), orders.filter(~F.coalesce(early, F.lit(False)))):
        store.refresh(sketches.sketched(batch, month, columns))
    kept = store.read()
    whole = sketches.estimates(kept, ["column_name"]).withColumn("month", F.lit("all"))
    seen = sketches.estimates(kept).unionByName(whole)
    exact = profile.distinct_counts(orders.select(*columns, "order_purchase_timestamp"), {"month": month}).unionByName(
        profile.distinct_counts(orders.select(*columns)).withColumn("month", F.lit("all")))
    near = F.abs(f("estimate") - f("distinct_values")) <= F.greatest(F.lit(1.0), sketches.ERROR * f("distinct_values"))
    return exact.where(f("column_name").isin(columns)).join(seen, ["column_name", "month"], "left").select(
        "column_name", "month", "distinct_values", F.coalesce(near, F.lit(False)).alias("within_error"))


query("key_candidates")(profile.key_candidates)
query("fk_profile")(profile.fk_profile)
query("trap_checks")(profile.trap_checks)
query("status_breakdown")(profile.status_breakdown)
query("orders_without_items")(profile.orders_without_items)
query("payment_types")(profile.payment_types)
query("untranslated_categories")(profile.untranslated_categories)
query("score_by_comment")(profile.score_by_comment)
query("month_completeness")(profile.month_completeness)


# --- step 4: quality --------------------------------------------------------------------------------
from shipshape.operators import quality  # noqa: E402

for _name in ("scope_checks", "review_outcome_by_status", "timestamp_checks", "duration_quantiles", "value_checks",
              "payment_reconciliation", "price_quantiles", "top5_price", "top5_freight", "duplicate_reviews",
              "shared_review_ids", "comment_checks", "survey_timing", "review_gaps_by_outcome",
              "review_gaps_by_status", "entity_checks", "value_without_category"):
    query(_name)(getattr(quality, _name))
query("fact_fill")(lambda s: quality.fact_fill(numbered_facts(s)))
query("flag_tristate")(lambda s: quality.flag_tristate(fo(s)))
query("repeat_definitions")(lambda s: quality.repeat_definitions(s.model["dim_customer"]))
query("outcome_band_contents")(lambda s: quality.outcome_band_contents(fo(s)))


# --- step 13: sources and sinks -------------------------------------------------------------------
from shipshape.sources import files  # noqa: E402


@query("table_listing")
def _table_listing(s):
    tabs = {f"raw.{k}": v for k, v in s.raw.items() if k != "order_reviews_keyed"}
    tabs.update({f"model.{k}": s.model[k] for k in ("dim_geography", "dim_date", "dim_product", "dim_seller",
                                                     "dim_customer", "fact_orders", "fact_order_items")})
    return files.list_tables(s.spark, tabs)


# --- written layers, asked by SQL -----------------------------------------------------------------
from shipshape.plans import layers as _layers  # noqa: E402

query("quarter_orders")(lambda s: _layers.quarter_orders(s.layers, C.QUARTER[0], C.QUARTER[1]))
query("state_views")(lambda s: _layers.state_views(s.layers))


def _folder(s, name: str) -> str:
    import uuid

    from shipshape.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(s.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip")
def _csv_round_trip(s):
    """Raw tables as CSV (texts with quotes and line breaks), read back by their declared types."""
    out, folder = None, _folder(s, "csv")
    for name in ("orders", "order_items", "order_reviews", "customers"):
        table = s.raw[name]
        files.write_csv(table, f"{folder}/{name}")
        back = files.read_csv(s.spark, f"{folder}/{name}", table.schema)
        filled = sum((F.count(c) for c in back.columns), F.lit(0).cast("bigint"))
        text = sum((F.coalesce(F.sum(F.length(x.name)), F.lit(0)) for x in back.schema.fields if x.dataType.simpleString() == "string"), F.lit(0).cast("bigint"))
        money = sum((F.coalesce(F.sum(x.name).cast("double"), F.lit(0.0)) for x in back.schema.fields if x.dataType.simpleString().startswith("decimal")), F.lit(0.0))
        one = back.agg(F.count(F.lit(1)).alias("rows"), filled.alias("filled"), text.alias("text_chars"), money.alias("money")).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("csv_cells_trimmed")
def _csv_cells_trimmed(s):
    """Cells padded with blanks, tabs and no-break spaces (or only of them), read trimmed, empty ones as NULL."""
    pads = F.array(*[F.lit(x) for x in (" ", "\t ", "\u00a0", "  \u2003")])
    people = s.raw["customers"].select(f("customer_id").cast("string").alias("customer_id"), F.when(f("customer_state").like("%1%"), F.lit("")).otherwise(f("customer_state")).alias("state"),
                                       "customer_city")
    pad = F.element_at(pads, (F.pmod(F.xxhash64("customer_id"), F.lit(4)) + 1).cast("int"))
    folder = _folder(s, "cells")
    files.write_csv(people.select(*[F.concat(pad, F.col(c), pad).alias(c) for c in people.columns]), folder)
    back = files.read_csv_trimmed(s.spark, folder)
    return back.groupBy("state", "customer_city").agg(F.count(F.lit(1)).alias("rows"), F.min(F.length("customer_id")).cast("bigint").alias("shortest_id"))


@query("parquet_round_trip")
def _parquet_round_trip(s):
    """The seven tables of the star exported, and imported with money as double."""
    names = ("dim_customer", "dim_date", "dim_geography", "dim_product", "dim_seller", "fact_orders", "fact_order_items")
    folder = _folder(s, "export")
    files.export_tables({n: s.model[n].drop("customer_order_number") for n in names}, folder)
    out = None
    for name in names:
        back = files.read_exported(s.spark, folder, name)
        money = [x for x in ("price", "items_value", "freight_value") if x in back.columns]
        total = sum((F.sum(F.col(x).cast("decimal(12,2)")).cast("double") for x in money), F.lit(0.0))  # cents, whatever the order of the sum
        one = back.agg(F.count(F.lit(1)).alias("rows"), total.alias("money")).select(F.lit(name).alias("table_name"), "rows", F.lit(len(back.columns)).cast("bigint").alias("columns"), "money")
        out = one if out is None else out.unionByName(one)
    return out


@query("described_tables")
def _described_tables(s):
    """Names and types of the raw columns, as the catalog gives them, with the rows that fill each."""
    out = None
    for name in profile.PROFILED:
        df = s.raw[name]
        parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(c).alias("filled")) for c in df.columns])
        filled = df.agg(parts.alias("p")).select(F.explode("p").alias("x")).select("x.*")
        one = files.describe(df).join(filled, "column_name").select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("file_examples")
def _file_examples(s):
    """The first filled value of each column in file order, long ones cut."""
    out = None
    for name in ("part", "customer", "supplier", "documents", "events"):
        df = getattr(s.tables, name)
        one = files.first_in_file(df.select("*", files.file_place().alias("_row")), [c for c, t in df.dtypes if t == "string"])
        one = one.select(F.lit(name).alias("table_name"), "column_name", exprs.shorten(f("example")).alias("example"))
        out = one if out is None else out.unionByName(one)
    return out


@query("about_figures")
def _about_figures(s):
    """figures of the whole period as a one-page text gives them, to the nearest hundred."""
    total = _kpi(s).filter(f("period") == "Total")
    names = ("orders", "delivered_orders", "late_orders", "reviewed_orders", "low_score_orders", "gmv")
    cells = F.array(*[F.struct(F.lit(n).alias("figure"), f(n).cast("double").alias("value")) for n in names])
    return total.select(F.explode(cells).alias("c")).select("c.figure", "c.value", exprs.about(f("c.value")).alias("about"))


@query("scenario_document")
def _scenario_document(s):
    """The nested scenario section, written beside a section of another shape, and every leaf read back by its path."""
    base, b, folder = _base(s), scenario.scenario_b_inputs(fo(s)), _folder(s, "document")
    states = scenario.state_inputs(fo(s), s.model["dim_geography"])
    targets = _targets(s)
    section = scenario.scenario_section(scenario.scenario_grid(targets, b, base), targets, b, scenario.scenario_ceiling(fo(s), base), states)
    totals = base.select(files.as_variant({c: f(c) for c in base.columns}).alias("doc"))
    files.write_sections({"scenario": section, "baseline": totals}, folder)
    return files.read_paths(s.spark, folder, "scenario", scenario.section_paths()).withColumn("text", F.when(f("value").isNull(), f("text"))).where("value is not null or text is not null")


@query("figures_json")
def _figures_json(s):
    from shipshape.operators import figures
    return figures.figures_long(figures.figure_sections(fo(s), _kpi(s), s.stg["orders"], s.model["dim_customer"]))
