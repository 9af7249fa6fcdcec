"""Statistics on coded review texts.

The coded set is the whole sampling frame: each framed review's comment document carries its codes
(primary / secondary category, quote flag and ``tag: <lang>`` notes; binding in FIXTURES.md §3). The
second coding for agreement is the labels table (two 0/1 codings of the same documents). All
statistics are grouped aggregations; the category list is a fixed eight-row table, broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shipshape import config as C
from shipshape.functions.exprs import count_if, ratio, squash_spaces, wilson

f = F.col


def categories(spark: SparkSession) -> DataFrame:
    """The codebook as a table (category, position)."""
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(C.CATEGORIES)], "category string, category_sort int")


def _cat_at(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in C.CATEGORIES]), (idx + 1).cast("int"))


def coded_reviews(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """Codes joined to the frame (unblinded) with the group sort key."""
    d = docs.select(F.col("doc_id").alias("comment_doc_id"), "source", "lang")
    x = frame.join(d, "comment_doc_id", "inner")
    p = F.pmod(F.regexp_extract(f("source"), r"(\d+)$", 1).cast("bigint"), F.lit(len(C.CATEGORIES)))
    shift = F.floor(f("comment_doc_id") / C.SECONDARY_EVERY)  # now and then by all categories: the secondary repeats the primary
    sec = F.when(f("comment_doc_id") % C.SECONDARY_EVERY == 0,
                 _cat_at(F.pmod(p + shift, F.lit(len(C.CATEGORIES)))))
    group_sort = F.array_position(F.array(*[F.lit(g) for g in C.DELIVERY_GROUPS]), f("delivery_group"))
    return x.select(
        f("review_id").alias("sample_id"), "review_id", "review_score", _cat_at(p).alias("primary_category"),
        sec.alias("secondary_category"),
        F.when(f("comment_doc_id") % C.QUOTE_EVERY == 0, F.lit("x")).alias("good_quote"),
        F.concat(F.lit("tag: "), f("lang"), F.lit("; source ")).alias("notes"),
        "delivery_outcome", "delivery_group", group_sort.cast("bigint").alias("delivery_group_sort"),
        "comment_doc_id")


def coding_violations(coded: DataFrame, frame: DataFrame, cats: DataFrame) -> DataFrame:
    """One row per violated rule (empty, unknown, repeated secondary, id coverage)."""
    known = cats.select(f("category").alias("_c"))
    empty = coded.filter(f("primary_category").isNull()).select("sample_id", F.lit("primary empty").alias("rule"))
    unk_p = (coded.filter(f("primary_category").isNotNull())
             .join(known, f("primary_category") == f("_c"), "left_anti")
             .select("sample_id", F.lit("unknown primary").alias("rule")))
    unk_s = (coded.filter(f("secondary_category").isNotNull())
             .join(known, f("secondary_category") == f("_c"), "left_anti")
             .select("sample_id", F.lit("unknown secondary").alias("rule")))
    rep = coded.filter(f("secondary_category") == f("primary_category")).select(
        "sample_id", F.lit("secondary repeats primary").alias("rule"))
    ids_c = coded.select("sample_id")
    ids_f = frame.select(f("review_id").alias("sample_id"))
    missing = ids_f.exceptAll(ids_c).select("sample_id", F.lit("not coded").alias("rule"))
    extra = ids_c.exceptAll(ids_f).select("sample_id", F.lit("not in sample").alias("rule"))
    return empty.unionByName(unk_p).unionByName(unk_s).unionByName(rep).unionByName(missing).unionByName(extra)


def _stacked(one: DataFrame, label: str, labels, cols) -> DataFrame:
    """Unpivot a one-row aggregate holding ``<col><i>`` per label into one row per label."""
    esc = [lab.replace("'", "''") for lab in labels]
    parts = ", ".join(f"'{lab}', " + ", ".join(f"{c}{i}" for c in cols) for i, lab in enumerate(esc))
    return one.selectExpr("_total", f"stack({len(labels)}, {parts}) AS ({label}, {', '.join(cols)})")


def category_shares_ci(coded: DataFrame, cats: DataFrame | None = None) -> DataFrame:
    """Primary count, share with Wilson CI, and 'mentioned' (primary or secondary) share;
    every codebook category appears, also with zero reviews.

    One aggregation pass over the coded rows (the codebook is a fixed list), so the coded set is
    read once and no total has to be joined back.
    """
    mentioned = F.array_compact(F.array("primary_category", "secondary_category"))
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, c in enumerate(C.CATEGORIES):
        aggs += [count_if(f("primary_category") == c).alias(f"p{i}"),
                 count_if(F.array_contains(mentioned, F.lit(c))).alias(f"m{i}")]
    x = _stacked(coded.agg(*aggs), "category", C.CATEGORIES, ["p", "m"])
    total = f("_total")
    lo, hi = wilson(f("p"), total)
    return x.select("category", f("p").alias("reviews"), ratio(f("p"), total).alias("share"), lo.alias("ci_low"),
                    hi.alias("ci_high"), f("m").alias("mentioned"), ratio(f("m"), total).alias("mentioned_share"))


def family(c: Column) -> Column:
    d, w, s = C.FAMILIES
    return F.when(c.isin(*C.DELIVERY_CATEGORIES), d).when(c.isin(*C.CONTENT_CATEGORIES), w).otherwise(s)


def category_families(coded: DataFrame) -> DataFrame:
    """The three families of primary categories with share and CI (one pass, fixed families).
    A family without reviews is not listed (as a grouping would not list it)."""
    fam = family(f("primary_category"))
    aggs = [F.count(F.lit(1)).alias("_total")] + [count_if(fam == name).alias(f"n{i}")
                                                   for i, name in enumerate(C.FAMILIES)]
    x = _stacked(coded.agg(*aggs), "family", C.FAMILIES, ["n"]).filter(f("n") > 0)
    lo, hi = wilson(f("n"), f("_total"))
    return x.select("family", f("n").alias("reviews"), ratio(f("n"), f("_total")).alias("share"),
                    lo.alias("ci_low"), hi.alias("ci_high"))


def family_by_group(coded: DataFrame) -> DataFrame:
    """R13, deck variant: the four families of the primary category per delivery group, with counts
    and shares of the group's reviews (families without reviews included). One grouped pass; the
    families are a fixed list, unpivoted with ``stack``."""
    fam = None
    for cat, name in C.FAMILY_4_OF.items():
        fam = F.when(f("primary_category") == cat, name) if fam is None else fam.when(f("primary_category") == cat, name)
    aggs = [F.count(F.lit(1)).alias("_total")] + [count_if(fam == name).alias(f"n{i}")
                                                   for i, name in enumerate(C.FAMILIES_4)]
    g = coded.groupBy("delivery_group").agg(*aggs)
    esc = [x.replace("'", "''") for x in C.FAMILIES_4]
    parts = ", ".join(f"'{x}', n{i}" for i, x in enumerate(esc))
    x = g.selectExpr("delivery_group", "_total", f"stack({len(esc)}, {parts}) AS (family, reviews)")
    return x.select("delivery_group", "family", "reviews", f("_total").alias("group_reviews"),
                    ratio(f("reviews"), f("_total")).alias("share"))


def category_crosstab(coded: DataFrame) -> DataFrame:
    """Category x delivery group, hits and column share (long form, zero cells included)."""
    groups = coded.groupBy("delivery_group", "delivery_group_sort").agg(F.count(F.lit(1)).cast("bigint").alias("members"))
    hits = coded.groupBy(f("primary_category").alias("category"), "delivery_group").agg(
        F.count(F.lit(1)).cast("bigint").alias("hits"))
    grid = groups.select("*", F.explode(F.array(*[F.lit(c) for c in C.CATEGORIES])).alias("category"))
    x = grid.join(hits, ["category", "delivery_group"], "left")
    h = F.coalesce(f("hits"), F.lit(0)).cast("bigint")
    return x.select("category", "delivery_group", "delivery_group_sort", h.alias("hits"), "members",
                    ratio(h, f("members")).alias("share"))


KEY_SHARES = (
    ("On time, several items: Incomplete order", "delivery_group", ("On time, several items",), ("Incomplete order",)),
    ("On time, single item: what arrived", "delivery_group", ("On time, single item",), C.CONTENT_CATEGORIES),
    ("On time: what arrived", "delivery_outcome", ("On time",), C.CONTENT_CATEGORIES),
    ("On time: Not received", "delivery_outcome", ("On time",), ("Not received",)),
    ("Late: Not received", "delivery_outcome", ("Late",), ("Not received",)),
    ("Late: delivery", "delivery_outcome", ("Late",), C.DELIVERY_CATEGORIES),
    ("Not delivered: Not received", "delivery_outcome", ("Not delivered",), ("Not received",)),
)


def key_shares_ci(coded: DataFrame) -> DataFrame:
    """Hits / members for each statement (group filter x category set) with Wilson CI, in one pass."""
    aggs = []
    for i, (_, col, members, cats_) in enumerate(KEY_SHARES):
        m = f(col).isin(*members)
        aggs += [count_if(m & f("primary_category").isin(*cats_)).alias(f"h{i}"), count_if(m).alias(f"n{i}")]
    one = coded.agg(*aggs)
    parts = ", ".join(f"'{label}', h{i}, n{i}" for i, (label, *_rest) in enumerate(KEY_SHARES))
    x = one.selectExpr(f"stack({len(KEY_SHARES)}, {parts}) AS (statement, hits, members)")
    lo, hi = wilson(f("hits"), f("members"))
    return x.select("statement", "hits", "members", ratio(f("hits"), f("members")).alias("share"),
                    lo.alias("ci_low"), hi.alias("ci_high"))


def tags(coded: DataFrame) -> DataFrame:
    """``tag: x`` parts of the ';'-separated notes."""
    x = coded.select("delivery_group", F.explode(F.split(F.coalesce(f("notes"), F.lit("")), ";")).alias("_p"))
    x = x.select("delivery_group", F.trim(f("_p")).alias("_p"))
    return x.filter(f("_p").startswith("tag: ")).select("delivery_group", F.expr("substring(_p, 6)").alias("tag"))


def tag_counts(coded: DataFrame) -> DataFrame:
    """Reviews per tag and delivery group, with the tag total (summed from its groups)."""
    g = tags(coded).groupBy("tag", "delivery_group").agg(F.count(F.lit(1)).cast("bigint").alias("reviews"))
    return g.withColumn("tag_total", F.sum("reviews").over(Window.partitionBy("tag")).cast("bigint"))


def coder_agreement(labels: DataFrame) -> DataFrame:
    """N, same, percent and Cohen's kappa of two codings (1.0 when expected agreement is 1).

    The table of both codes is counted once; its margins are sums of its cells.
    """
    cells = labels.groupBy(f("quality").cast("string").alias("a"), (1 - f("toxic")).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(F.struct(f("a").alias("c"), f("n").alias("na"), zero.alias("nb"), F.when(f("a") == f("b"), f("n")).otherwise(zero).alias("same")),
                    F.struct(f("b").alias("c"), zero.alias("na"), f("n").alias("nb"), zero.alias("same")))
    margins = cells.select(F.explode(sides).alias("s")).select("s.*").groupBy("c").agg(*[F.sum(x).alias(x) for x in ("na", "nb", "same")])
    by_chance = F.sum(F.when(f("c").isNotNull(), f("na") * f("nb"))).cast("double")
    one = margins.agg(F.coalesce(F.sum("na"), zero).cast("bigint").alias("reviews"), F.coalesce(F.sum("same"), zero).cast("bigint").alias("same"), by_chance.alias("chance"))
    expected, observed = ratio(f("chance"), f("reviews") * f("reviews")), ratio(f("same"), f("reviews"))
    kappa = F.when(expected == 1, F.lit(1.0)).otherwise((observed - expected) / (1 - expected))
    return one.select("reviews", "same", observed.alias("share_same"), kappa.alias("kappa"))


def coder_disagreements(labels: DataFrame) -> DataFrame:
    """R18."""
    return (labels.select("doc_id", f("quality").cast("bigint").alias("first_pass"),
                          (1 - f("toxic")).cast("bigint").alias("second_pass"))
            .filter(f("first_pass") != f("second_pass")))


def quoted(coded: DataFrame) -> DataFrame:
    """Coded reviews marked as quotes."""
    return coded.filter(f("good_quote").isNotNull())


def quote_candidates(quotes: DataFrame) -> DataFrame:
    """Quoted reviews (with their comments), whitespace collapsed and '|' replaced."""
    return quotes.select(
        "sample_id", f("primary_category").alias("category"), "delivery_group",
        F.translate(squash_spaces(f("review_comment_message")), "|", "/").alias("comment"))


def mentioned_share(frame: DataFrame, coded: DataFrame, category: str = "Incomplete order") -> DataFrame:
    """Frame size by distinct review id; share of coded reviews mentioning one category."""
    n_frame = frame.agg(F.count_distinct("review_id")).scalar()
    hit = F.array_contains(F.array_compact(F.array("primary_category", "secondary_category")), F.lit(category))
    return coded.agg(F.count(F.lit(1)).cast("bigint").alias("coded"), count_if(hit).alias("mentioning")).select(
        n_frame.cast("bigint").alias("frame_reviews"), "coded", "mentioning",
        ratio(f("mentioning"), f("coded")).alias("mentioning_share"))
