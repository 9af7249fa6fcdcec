"""Corpus pipeline: quality classifier, Jaccard join, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet into the
shared folder and rereads them for the next. Filtering stages decide row by row: rows that share an
id, or have none, are told apart by a key of all their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shipshape.llm.balance import mixed
from shipshape.llm.common import table, written
from shipshape.llm.decontaminate import leaks
from shipshape.llm.jaccard_join import jaccard_components
from shipshape.llm.quality import classify
from shipshape.llm.queries import tokenizer_file
from shipshape.llm.tokens import token_digests

#: Ids of dropped documents that are sent to every executor; more are joined by shuffle.
SENT_IDS = 1_000_000


def ids_name_rows(docs: DataFrame) -> bool:
    """Whether every row has an id of its own."""
    return docs.select("doc_id").groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()


def row_key(docs: DataFrame) -> Column:
    """A 64-bit key of each row: equal for equal rows, different for all other rows of ``docs``.

    Where every row has an id of its own, that is the key. Otherwise it is a hash of all columns;
    unlike rows of one hash would show by a second one, and then another seed is taken.
    """
    if ids_name_rows(docs):
        return F.col("doc_id")
    cells = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    seed = 0
    while True:
        both = docs.select(F.xxhash64(F.lit(seed), *cells).alias("a"), F.xxhash64(F.lit(seed + 1), *cells).alias("b"))
        if both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high").isEmpty():
            return F.xxhash64(F.lit(seed), *cells)
        seed += 2


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key isn't among ``dropped`` (one column)."""
    dropped = written(dropped.toDF("dropped_row").distinct())
    side = F.broadcast(dropped) if dropped.count() <= SENT_IDS else dropped
    return docs.join(side, key == side["dropped_row"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 10 accepts."""
    labels = table(spark, sf_dir, "labels")
    if ids_name_rows(docs):
        return _without(docs, F.col("doc_id"), classify(docs, labels).where("predicted = 0").select("doc_id"))
    key = row_key(docs)
    scored = classify(docs.select("doc_id", "text", key.alias("row")), labels, row_col="row")
    return _without(docs, key, scored.where("predicted = 0").select("row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null last), of each group linked by operator 9 (five words, 0.8); of equal rows one."""
    key = row_key(docs)
    rows = docs.select(key.alias("row"), "doc_id")
    found = written(jaccard_components(docs.select(key.alias("row"), "text"), id_col="row", words=5, num=80, den=100).select("row", "component_id").distinct())
    grouped = found.groupBy("component_id").count().where("count > 1").select("component_id")
    linked = found.join(grouped, "component_id").join(rows, "row")
    stays = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row").alias("row"))).alias("s"))
    single = _without(docs, key, linked.select("row", "component_id").join(stays, "component_id").where("row <> s.row").select("row"))
    again = written(rows.groupBy("row").count().where("count > 1").select("row"))
    if again.isEmpty():
        return single
    equal = single.withColumn("equal_row", key).join(again, F.col("equal_row") == F.col("row"), "left_semi")
    return _without(single, key, again).unionByName(equal.dropDuplicates(["equal_row"]).drop("equal_row"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 4 finds no benchmark item."""
    key = row_key(docs)
    found = leaks(docs.select(key.alias("row"), "text"), table(spark, sf_dir, "benchmark"), id_col="row")
    return _without(docs, key, found.select("row"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as operator 1 takes it."""
    return mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of operator 7, read back: doc_id, start, n_tokens, ids_crc32 per row of the mix."""
    return token_digests(docs, tokenizer_file())


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate),
          ("mixing to target weights", mixing), ("token files", token_files)]

ORACLE_SQL = None
#: Why not, and the test that holds every stage against brute force.
WITHOUT_SQL = ("trained trees, fingerprints and token ids", "tests/llm/test_operators.py::test_pipeline_stages_equal_brute_force")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
