
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shipshape.plans.star import Star, star_for

QUERIES: dict[str, Callable[[Star], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE output column (both engines round the same way; see SURVEY §7.1)."""
    cols = [F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def run(name: str, spark: SparkSession, src: str) -> DataFrame:
    return round_doubles(QUERIES[name](star_for(spark, src)))


def _load_all():
    # importing the modules registers their queries
    from shipshape.operators import registered  # noqa: F401


_load_all()
