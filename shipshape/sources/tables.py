"""Readers for the driver's parquet tables (one file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Rows of the larger side that one task of a join by order takes, about; small tables are dealt to idle cores.
TASK_ROWS, LEAST_ROWS = 250_000, 25_000
#: Tables by order of more rows are never sent whole to every task.
SENT_ROWS = 250_000
#: Ids and states of more sellers are not sent whole to every task (some 60 MB).
SENT_SELLERS = 1_000_000

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(src: str, name: str) -> str:
    return os.path.join(src, f"{name}.parquet")


# --- fixed values: schemas of the input tables (as documented in FIXTURES.md §2) ------------------
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, src: str, name: str) -> DataFrame:
    """Parquet scan with the declared schema (no inference job reading footers); Catalyst prunes
    columns and pushes filters into the scan. Tables without a declared schema are inferred."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(table_path(src, name))


class Tables:
    """Lazy accessor ``Tables(spark, src).orders`` -> DataFrame.

    One DataFrame per table and folder: the file listing and footer (schema) read happen once,
    not once per use in a plan.
    """

    def __init__(self, spark: SparkSession, src: str):
        self.spark = spark
        self.src = src
        self._frames: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    def rows(self, name: str) -> int:
        if name not in self._rows:
            self._rows[name] = getattr(self, name).count()
        return self._rows[name]

    def tasks(self, *names: str) -> int:
        """Tasks for a join of these tables, by the rows of the largest (counted from footers)."""
        rows = max(self.rows(name) for name in names)
        return max(2, -(-rows // TASK_ROWS), min(self.spark.sparkContext.defaultParallelism, rows // LEAST_ROWS))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = read_table(self.spark, self.src, name)
        return self._frames[name]
